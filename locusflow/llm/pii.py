"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

Values are found by pattern and then validated: card numbers by their check digit, account numbers, with or without single spaces, by remainder 97,
addresses by octet range, dates by the calendar. A valid value becomes a number below the count of values of its format,
is permuted by a Feistel network walked until it is within that count, and written back in the same format with check
digits made anew. The permutation depends on the key and the kind of value alone, so equal values stay linked across
documents. Text outside valid values stays as it is.

Mail addresses keep their domain in clear. Values of more than PIECE letters and digits (secrets, names of mail boxes) are permuted piece by
piece, so that a value's length bounds neither the mask nor the time. Whoever has the key can go back; so there is no default one.

Null texts stay null, empty and very long ones are texts like any other. Rows that repeat and other columns come back as they are;
pseudonymise() replaces the text column. An empty table gives an empty one.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import documents, trimmed

#: Key for the synthetic tables alone, on which nothing is secret.
SAMPLE_KEY = "synthetic tables"
PIECE = 64
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049

_PATTERN = re.compile(
    r"""(?P<email>(?<![\w.+%-])[A-Za-z0-9](?:[\w.+%-]*[\w+%-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)
    |(?P<key>(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9]))
    |(?P<secret>(?:(?<=password=)|(?<=token\ =\ ")|(?<=token=)|(?<=secret=)|(?<=api_key=))[A-Za-z0-9]{8,})
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9]))
    |(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w(])\(\d{3}\)[ ]?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}-\d{3}-\d{4}(?![\w-]))
    |(?P<ssn>(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<ymd>(?<![\w./-])(?:19|20)\d\d([-/.])\d\d\8\d\d(?![\w/-]))
    |(?P<dmy>(?<![\w./-])\d\d([-/.])\d\d\10(?:19|20)\d\d(?![\w/-]))
    |(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d))
    |(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w]|\.\d))""",
    re.VERBOSE,
)
#: Every text with a match of _PATTERN has one of these.
_LIKELY = re.compile(r"[\d@]|AKIA|password=|secret=|token|api_key=")


class Permutation:
    """A keyed permutation of the numbers below any n."""

    def __init__(self, key: str, rounds: int = 10):
        self.key, self.rounds = hashlib.blake2b(key.encode(), digest_size=32).digest(), rounds

    def __call__(self, value: int, n: int, kind: str) -> int:
        if n < 2:
            return value
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask, width = (1 << half) - 1, (half + 7) // 8
        if width > 64:
            raise ValueError("permute a value of so many places in pieces")
        while True:
            a, b = value >> half, value & mask
            for r in range(self.rounds):
                h = hashlib.blake2b(b"%d|%s|%d|" % (r, kind.encode(), n) + b.to_bytes(width, "big"), key=self.key, digest_size=max(8, width)).digest()
                a, b = b, a ^ (int.from_bytes(h, "big") & mask)
            value = a << half | b
            if value < n:
                return value


def luhn(digits: str) -> int:
    """Sum by which a number with its check digit is divisible by ten."""
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))


def _remainder(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _account(text: str) -> str | None:
    """The account number that a text of groups begins with: in groups of four before any other, then the longest."""
    groups, found = text.split(" "), []
    for k in range(len(groups), 0, -1):
        own = "".join(groups[:k])
        if 15 <= len(own) <= 34 and _remainder(own) == 1:
            found.append((k > 1 and any(len(g) != 4 for g in groups[: k - 1]) or len(groups[k - 1]) > 4 and k > 1, -k))
    return " ".join(groups[: -min(found)[1]]) if found else None


class Pseudonyms:
    """Pseudonyms of values found in texts; those given before are kept by value."""

    def __init__(self, key: str):
        self.permute, self.known = Permutation(key), {}

    def _digits(self, text: str, kind: str, keep: int = 0) -> str:
        """The digits of a text permuted, but for the first few; all else in place."""
        own = re.sub(r"\D", "", text)
        n = len(own) - keep
        new = own[:keep] + str(self.permute(int(own[keep:]), 10**n, f"{kind}{n}")).zfill(n)
        it = iter(new)
        return re.sub(r"\d", lambda _: next(it), text)

    def _classes(self, text: str, kind: str) -> str:
        """ASCII letters and digits permuted within their classes."""
        if len(text) > PIECE:
            return "".join(self._classes(text[k : k + PIECE], f"{kind}{k}.") for k in range(0, len(text), PIECE))
        sets = ["0123456789", "abcdef" if re.fullmatch(r"[0-9a-f]+", text) else "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
        of = [next((s for s in sets if c in s), "") for c in text]
        value, n = 0, 1
        for c, s in zip(text, of):
            if s:
                value, n = value * len(s) + s.index(c), n * len(s)
        value = self.permute(value, n, kind + "".join(str(len(s)) for s in of if s))
        out = []
        for c, s in zip(reversed(text), reversed(of)):
            if s:
                value, k = divmod(value, len(s))
                c = s[k]
            out.append(c)
        return "".join(reversed(out))

    def _date(self, text: str, first: bool) -> str | None:
        a, b, c = re.split(r"\D", text)
        sep = text[len(a)]
        for order in [(a, b, c)] if first else [(c, b, a), (c, a, b)]:
            try:
                day = datetime.date(*map(int, order)).toordinal() - FIRST_DAY
            except ValueError:
                continue
            if not 0 <= day < DAYS:
                continue
            new = datetime.date.fromordinal(self.permute(day, DAYS, "date") + FIRST_DAY)
            y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
            return sep.join((y, m, d) if first else (d, m, y) if order == (c, b, a) else (m, d, y))
        return None

    def make(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None where the value is not valid."""
        if kind == "email":
            local, at = text.rsplit("@", 1)
            return f"{self._classes(local, 'email')}@{at}"
        if kind == "key":
            return "AKIA" + self._classes(text[4:], "key")
        if kind == "secret":
            return self._classes(text, "secret")
        if kind == "phone":
            code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d(?=\d{10})", text)
            return self._digits(text, "phone", len(code[0]) - 1 if code else 0)
        if kind in ("ymd", "dmy"):
            return self._date(text, kind == "ymd")
        if kind == "ip":
            parts = [int(x) for x in text.split(".")]
            if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
                return None
            n = self.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
            return ".".join(map(str, n.to_bytes(4, "big")))
        if kind == "ssn":
            if not self._ssn(text):
                return None
            while not self._ssn(text := self._digits(text, "ssn")):
                pass
            return text
        if kind == "card":
            own = re.sub(r"\D", "", text)
            if luhn(own) % 10 or len(set(own)) == 1:
                return None
            body = own[0] + str(self.permute(int(own[1:-1]), 10 ** (len(own) - 2), f"card{len(own)}")).zfill(len(own) - 2)
            it = iter(body + str(-luhn(body + "0") % 10))
            return re.sub(r"\d", lambda _: next(it), text)
        if kind == "iban":
            own = text.replace(" ", "")
            new = own[:2] + "00" + self._classes(own[4:], "iban")
            it = iter(new[:2] + f"{98 - _remainder(new):02d}" + new[4:])
            return "".join(c if c == " " else next(it) for c in text)
        raise ValueError(kind)

    @staticmethod
    def _ssn(text: str) -> bool:
        a, b, c = text.split("-")
        return a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000"

    def text(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms and (kind, start, end) of what was replaced, in the text given."""
        if not _LIKELY.search(text):
            return text, []
        spans, out, at, begin = [], [], 0, 0
        while m := _PATTERN.search(text, begin):
            value, begin = m[0], m.end()
            kind = next(k for k, v in m.groupdict().items() if v is not None)
            if kind == "iban":
                own = _account(value)
                begin = m.start() + len(own or value.split(" ")[0])  # what follows is searched by itself
                if own is None:
                    continue
                value = own
            new = self.known.get((kind, value), "")
            if new == "":
                if len(self.known) > 50_000:
                    self.known.clear()
                new = self.known[kind, value] = self.make(kind, value)
            if new is not None:
                spans.append((kind, m.start(), begin))
                out += [text[at : m.start()], new]
                at = begin
        return "".join([*out, text[at:]]), spans


_BY_KEY: dict[str, Pseudonyms] = {}


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", spans_col: str | None = None) -> DataFrame:
    """docs with pseudonyms in text_col; spans_col, if named, gets an array of (kind, start, end)."""
    names = docs.columns
    at = names.index(text_col)
    if spans_col in names:
        raise ValueError(f"there is a column {spans_col} already")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _BY_KEY.setdefault(key, Pseudonyms(key))
        for batch in batches:
            done = [(None, []) if t is None else own.text(t) for t in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array([t for t, _ in done], pa.string())
            if spans_col:
                cols.append(pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for _, spans in done], kind))
            yield pa.RecordBatch.from_arrays(cols, names=[*names, spans_col] if spans_col else names)

    schema = docs.schema
    if spans_col:
        span = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
        schema = StructType([*schema.fields, StructField(spans_col, ArrayType(span))])
    return docs.mapInArrow(run, schema)


def key_of(spark: SparkSession, otherwise: str | None = None) -> str:
    """spark.locusflow.pii.key; without it, pseudonyms are not made unless the caller names a key."""
    key = spark.conf.get("spark.locusflow.pii.key", None) or otherwise
    if not key:
        raise ValueError("set spark.locusflow.pii.key to a secret")
    return key


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pseudonymise(docs, key_of(spark, SAMPLE_KEY), spans_col="spans").select("doc_id", "text", F.size("spans").alias("n_found"), F.array_sort(F.array_distinct(F.col("spans.kind"))).alias("kinds"))
