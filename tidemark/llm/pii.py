"""Personal data in texts, with SQL functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for account
numbers, octet bounds for addresses, digit counts for phones), and words nearby adjust the score of
the kinds that a pattern alone can't settle.  Positions are code points, ends exclusive.

A match starts where the one before ended or where its first run of characters starts, and repeats
are possessive: the same leftmost matches, found in time linear in the text and with constant stack.
Matches are placed and scored from the gaps between them, so time is linear in their number too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of the contract in their order, then those that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "phone_local")
KINDS = BASE + ADDED
PATTERNS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}(?:\\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone_local": "(?<![0-9+().-])(?:\\([0-9]{2,5}\\)\\x20?|0[0-9]{1,4}[\\x20-])[0-9]{3,4}[\\x20-]?[0-9]{3,5}(?![0-9-])",
}
#: Score of a confirmed match, and what a context word within WINDOW code points before it adds.
SCORES = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.4, "phone_local": 0.4}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|konto|cuenta|compte",
    "ssn": "ssn|social|security",
    "phone_local": "phone|tel|call|mobile|fax",
}
WINDOW, BONUS, THRESHOLD = 40, 0.3, 0.6
#: A text holds less than FAN ** ROUNDS matches; NEAR of them, with the gaps between, fill a WINDOW.
FAN, ROUNDS, NEAR = 32, 6, 16


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits of a text pass Luhn's checksum."""
    odd = lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    digits = F.transform(F.split(F.reverse(_digits(number)), ""), lambda x: x.try_cast("int"))
    return F.aggregate(F.transform(F.filter(digits, lambda x: x.isNotNull()), odd), F.lit(0), lambda s, x: s + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number leaves 1 when divided by 97, letters counting 10 to 35, head last."""
    plain = F.regexp_replace(account, "\\x20", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    values = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda s, v: (s * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(x.try_cast("int"), F.when(F.ltrim(x, F.lit("0")) == "", 0), F.ltrim(x, F.lit("0")).try_cast("int")) <= 255)
        return F.forall(F.split(m, "[.]"), part)
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return mod97(m) if kind == "iban" else F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: Spark computes a column anew wherever a lambda names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(values: Column) -> Column:
    """Running sums: every round adds up FAN sums, each of FAN times as many elements as in the round before.

    A fold that gathers them would copy its whole state at each element.
    """

    def add(a: Column, step: int) -> Column:
        at = lambda i: F.aggregate(F.sequence(F.lit(0), F.least(F.lit(FAN - 1), F.floor(i / step).cast("int"))), F.lit(0), lambda s, j: s + F.get(a, i - j * step))
        return F.transform(a, lambda _, i: at(i))

    def rounds(a: Column, step: int) -> Column:
        return a if step >= FAN**ROUNDS else F.when(F.size(a) > step, _let(add(a, step), lambda b: rounds(b, step * FAN))).otherwise(a)

    return _let(values, lambda a: rounds(a, 1))


def _placed(kind: str, text: Column) -> Column:
    """All matches of a kind: (m, start, end, near), near being the WINDOW code points before the match."""
    found, gaps = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0), F.split(text, PATTERNS[kind])
    last = lambda x: F.right(x, F.lit(WINDOW))
    pieces = F.filter(F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), F.char_length(m).alias("n"), F.char_length(g).alias("gap"), last(g).alias("last"))), lambda x: x["m"].isNotNull())

    def place(p: Column) -> Column:
        ends = _sums(F.transform(p, lambda x: x["gap"] + x["n"]))
        before = lambda a, i: F.aggregate(F.sequence(F.least(F.lit(NEAR - 1), i), F.lit(0), F.lit(-1)), F.lit(""), lambda s, j: last(F.concat(s, F.get(a, i - j))))
        tails = _let(F.transform(p, lambda x: last(F.concat(x["last"], x["m"]))), lambda a: F.transform(a, lambda _, i: before(a, i)))
        ended = F.zip_with(p, ends, lambda x, e: F.struct(x["m"].alias("m"), (e - x["n"]).alias("start"), e.alias("end"), x["last"].alias("last")))
        return F.zip_with(ended, F.concat(F.array(F.lit("")), tails), lambda x, t: F.struct(x["m"].alias("m"), x["start"].alias("start"), x["end"].alias("end"), last(F.concat(t, x["last"])).alias("near")))

    return F.filter(_let(pieces, place), lambda x: x["m"].isNotNull())


def _spans(kind: str, text: Column) -> Column:
    """All confirmed matches of a kind: (kind, start, end, score), by start."""

    def scored(x: Column) -> Column:
        score = F.lit(SCORES[kind]) + F.when(F.lower(x["near"]).rlike(f"(?<![a-z])(?:{CONTEXT[kind]})"), BONUS).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.round(F.least(score, F.lit(1.0)), 2).alias("score"))

    spans = F.transform(F.filter(_placed(kind, text), lambda x: _valid(kind, x["m"])), scored)
    spans = spans if kind in BASE else F.filter(spans, lambda x: x["score"] >= THRESHOLD)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.when(text.rlike(PATTERNS[kind]), spans).otherwise(empty)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one array of spans (kind, start, end, score) a kind, for every row.

    Null and empty texts have no spans.  Overlapping matches of different kinds are all told.  Base
    kinds count whenever confirmed; added kinds only when pattern, checksum and context reach
    THRESHOLD.  Repeated rows and null ids are kept as rows; an empty table gives no rows.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return text.select("doc_id", "text", *(_spans(k, F.col("text")).alias(k) for k in KINDS))


def _joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    place = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, kinds)), x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(place, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, best_score for every row."""
    found = find_pii(docs, id_col, text_col)
    base, every = F.concat(*BASE), F.concat(*KINDS)
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(_joined(base, BASE), 256).alias("base_sha256"), _joined(every, KINDS).alias("spans"), F.array_max(F.transform(every, lambda x: x["score"])).alias("best_score"))


