"""Personal data in texts, in DataFrame functions only.

For each kind a regular expression proposes spans, leftmost and non-overlapping; a validator confirms them
(Luhn for cards, mod-97 for account numbers, ranges and counts of digits for the others); words within
NEAR code points before and after adjust the score. Confirmed spans of the base kinds always stay, those of the
added kinds with a score of THRESHOLD or more, so that context decides on forms that are common elsewhere. A
match that fails is dropped and not tried again in part. The added kinds are account numbers (iban),
social security numbers and dates of birth; their spans may overlap those of other kinds.

Places of matches come from the lengths of what lies between them: a regular expression splits the text,
the running sum of the lengths gives the ends. The sum takes log(n) passes over the array, no loop over pairs.
The expressions run in time linear in the text: they start where a run starts and never give back what they took.

Null text is empty; a row without spans has an empty array. Every row gives one row, repeated rows and null
keys too, an empty table gives none. An input column called __spans is replaced; columns that start with
__pii are the operator's own. Places count code points from 0, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40        # code points of context on either side, up to the next match of the kind
THRESHOLD = 50   # of 100
SPAN = "array<struct<kind string, start bigint, end bigint, text string, score int>>"


def _digits(found: Column) -> Column:
    return F.translate(found, " ().+-", "")


def _fold(text: Column, start: Column, step: Callable[[Column, Column, Column], Column]) -> Column:
    """Fold over the characters of a short ASCII text: step(sum so far, place from 1, code)."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.aggregate(places, start, lambda acc, i: step(acc, i, F.ascii(F.substr(text, i, F.lit(1)))))


def luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, the sum of all digits is a multiple of ten."""
    def step(acc, i, code):
        d = code - 48
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return _fold(F.reverse(digits), F.lit(0), step) % 10 == 0


def mod97(account: Column) -> Column:
    """The first four characters moved to the end, letters read as 10 to 35: the rest by 97 is 1."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(acc, i, code):
        return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)
    return _fold(moved, F.lit(0), step) == 1


def _only_if(condition: Column, then: Column) -> Column:
    return F.when(condition, then).otherwise(F.lit(False))


def is_card(found: Column) -> Column:
    return _only_if(F.length(_digits(found)).between(13, 19), luhn(_digits(found)))


def is_phone(found: Column) -> Column:
    return F.length(_digits(found)).between(9, 15)


def is_address(found: Column) -> Column:
    """Four numbers of at most 255."""
    return found.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$") & ~found.endswith(".")


def is_account(found: Column) -> Column:
    account = F.translate(found, " ", "")
    return _only_if(F.length(account).between(15, 34), mod97(account))


def is_security_number(found: Column) -> Column:
    return (found.rlike("^[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}$") & ~found.rlike("^(?:000|666)")
            & ~found.rlike("^.{4}00") & ~found.endswith("0000"))


def is_date(found: Column) -> Column:
    day, month, year = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
    return found.rlike(f"^(?:{year}-{month}-{day}|{day}[./]{month}[./]{year}|{month}/{day}/{year})$")


def _words(*words: str) -> str:
    return f"(?i)(?:^|[^a-z])(?:{'|'.join(words)})(?:[^a-z]|$)"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str                            # plain form, as SQL can read it
    guarded: str                            # the same matches, found in linear time
    confirm: Callable[[Column], Column] | None
    score: int                              # of a confirmed span
    for_it: str = ""                        # context that raises the score
    gain: int = 0
    against: str = ""                       # context that lowers it
    loss: int = 0
    base: bool = False


_FIRST_DIGIT = r"(?:\G|(?<![0-9]))"
_FIRST_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))"
KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
         _FIRST_LOCAL + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, 90,
         _words("e-?mail", "contact", "write", "mailto"), 10, base=True),
    Kind("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
         _FIRST_DIGIT + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", is_address, 60,
         _words("ip", "address", "host", "server"), 30, _words("version", "release", "section"), 40, base=True),
    Kind("card", r"[0-9](?:[ -]?[0-9])+", r"[0-9](?:[ -]?[0-9])++", is_card, 80,
         _words("card", "visa", "credit", "karte", "tarjeta", "carte"), 20,
         _words("order", "serial", "tracking", "isbn"), 40, base=True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", is_phone, 70,
         _words("phone", "tel", "call", "mobile", "fax", "telefon", "tel[eé]fono", "t[eé]l[eé]phone"), 30, base=True),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})",
         r"[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})", is_account, 80,
         _words("iban", "account", "konto", "cuenta", "compte"), 20),
    Kind("ssn", r"[0-9]+(?:-[0-9]+)+", _FIRST_DIGIT + r"[0-9]++(?:-[0-9]++)++", is_security_number, 30,
         _words("ssn", "social security", "sozialversicherung", "seguridad social"), 50,
         _words("order", "invoice", "part"), 30),
    Kind("birth", r"[0-9]+(?:[./-][0-9]+)+", _FIRST_DIGIT + r"[0-9]++(?:[./-][0-9]++)++", is_date, 20,
         _words("born", "birth", "birthday", "dob", "geboren", "geburtsdatum", "nacid[oa]", "nacimiento", "naissance"), 50),
)


def running_sum(numbers: Column) -> Column:
    """Sums of all elements up to each, by doubling distances."""
    def add_shifted(acc: Column, power: Column) -> Column:
        by = F.call_function("shiftleft", F.lit(1), power)
        shifted = F.concat(F.array_repeat(F.lit(0).cast("long"), by), F.slice(acc, F.lit(1), F.size(acc) - by))
        return F.when(by < F.size(acc), F.zip_with(acc, shifted, lambda a, b: a + b)).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), numbers, add_shifted)


def _proposed(df: DataFrame, kind: Kind, to: str) -> DataFrame:
    """Adds the column `to`: an array of found text, code points skipped before it, context."""
    rest = [F.col(f"`{c}`") for c in df.columns]
    pattern = F.lit(kind.guarded)
    df = df.select(*rest, F.regexp_extract_all("__pii_text", pattern, F.lit(0)).alias("__pii_found"))
    df = df.select(*rest, "__pii_found", F.when(F.size("__pii_found") > 0, F.split("__pii_text", kind.guarded, -1))
                   .alias("__pii_gaps"))
    met = F.zip_with("__pii_found", F.slice("__pii_gaps", F.lit(1), F.size("__pii_found")), lambda found, gap: F.struct(
        found.alias("text"), F.length(gap).cast("long").alias("skip"), F.right(gap, F.lit(NEAR)).alias("near")))
    met = F.zip_with(met, F.slice("__pii_gaps", F.lit(2), F.size("__pii_found")), lambda m, gap: F.struct(
        m["text"].alias("text"), m["skip"].alias("skip"),
        F.concat_ws(" ", m["near"], F.left(gap, F.lit(NEAR))).alias("near")))
    return df.select(*rest, F.when(F.size("__pii_found") > 0, met).alias(to))


def _confirmed(kind: Kind, found: Column, threshold: int) -> Column:
    ends = running_sum(F.transform(found, lambda m: m["skip"] + F.length(m["text"])))

    def span(m: Column, end: Column) -> Column:
        score = F.lit(kind.score)
        if kind.for_it:
            score = score + F.when(m["near"].rlike(kind.for_it), kind.gain).otherwise(0)
        if kind.against:
            score = score - F.when(m["near"].rlike(kind.against), kind.loss).otherwise(0)
        return F.struct(F.lit(kind.name).alias("kind"), (end - F.length(m["text"])).alias("start"), end.alias("end"),
                        m["text"].alias("text"), score.alias("score"))
    spans = F.zip_with(found, ends, span)
    if kind.confirm:
        spans = F.filter(spans, lambda x: kind.confirm(x["text"]))
    if not kind.base:
        spans = F.filter(spans, lambda x: x["score"] >= threshold)
    return F.when(found.isNotNull(), spans)


def find_personal(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS,
                  threshold: int = THRESHOLD) -> DataFrame:
    """All rows and columns with __spans: kind, start, end, text and score, by kind as listed, then start."""
    df = docs.drop("__spans").withColumn("__pii_text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    for n, kind in enumerate(kinds):
        df = _proposed(df, kind, "__pii_met")
        df = df.withColumn(f"__pii_{n}", _confirmed(kind, F.col("__pii_met"), threshold)).drop("__pii_met")
    none = F.array().cast(SPAN)
    found = [F.coalesce(F.col(f"__pii_{n}").cast(SPAN), none) for n in range(len(kinds))]
    out = df.withColumn("__spans", F.concat(none, *found))
    return out.drop("__pii_text", *(f"__pii_{n}" for n in range(len(kinds))))


def count_of(kind: str, spans: str = "__spans") -> Column:
    return F.size(F.filter(F.col(spans), lambda x: x["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with [KIND] in place of each span; one that begins inside an earlier one only widens the gap.

    Each span costs a walk through the text.
    """
    text = F.coalesce(text, F.lit(""))
    by_place = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["end"], x["kind"])))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(F.substr(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")),
                         F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"),
                        F.concat(acc["out"], F.when(x["start"] >= acc["at"], piece).otherwise("")).alias("out"))
    return F.aggregate(by_place, start, step, lambda acc: F.concat(
        acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))))
