"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is an expression on one text column: a match is fenced with a mark,
the text is split at the mark, and the lengths of the pieces give code-point
offsets. No shuffle, no Python.

Base kinds are leftmost and non-overlapping per kind: ``email``, ``ip`` (parts
at most 255), ``card`` (14 to 19 digits, Luhn) and ``phone`` (10 to 15 digits).
Added kinds: ``iban`` (mod 97) and ``local_phone`` (numbers without a country
code, which need a context word nearby). A failing match is dropped, not
retried. The mark character U+0001 reads as U+0002, also in the ``value`` of a
span. Null and empty texts have no spans; repeated rows get equal results;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "local_phone")
BASE_KINDS = 4
MIN_SCORE = 0.5
CONTEXT_CHARS = 40

_MARK, _OTHER = "\u0001", "\u0002"

# The same matches as the plain patterns: a run is only entered at its start or
# where the last match ended, and runs never give back characters, so long runs
# without a match take linear time.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+]|[0-9+][\x20().-]|[0-9][\x20.-]\()\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[\x20.-][0-9])",
}
# Start of the score, and words that raise it when they stand nearby.
START = {"email": 0.7, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "local_phone": 0.35}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|karte|carte|tarjeta|payment",
    "phone": "phone|call|tel|mobile|fax|anruf",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "local_phone": "phone|call|tel|mobile|fax|anruf",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for use at several places of an expression."""
    return F.transform(F.array(value), body)[0]


def sums_before(lengths: Column, block: int = 256) -> Column:
    """For each element, the sum of the earlier ones, by blocks (not quadratic)."""
    add = lambda a, x: a + x.cast("long")
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), add)

    def blocks(x: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: total(F.slice(x, b * block + 1, F.lit(block))))
        return let(sums, lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda b: total(F.slice(s, F.lit(1), b))))

    def inside(x: Column, starts: Column) -> Column:
        return F.transform(x, lambda _, i: F.get(starts, F.floor(i / block).cast("int")) + total(F.slice(x, F.floor(i / block).cast("int") * block + 1, i % block)))

    return let(lengths, lambda x: let(blocks(x), lambda s: inside(x, s)))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    def step(total: Column, d: Column, i: Column) -> Column:
        twice = d * 2
        return total + F.when(i % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    values = F.transform(F.split(F.reverse(number), ""), lambda c: c.cast("int"))
    return let(values, lambda v: F.aggregate(F.transform(v, lambda d, i: step(F.lit(0), d, i)), F.lit(0), lambda a, x: a + x)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (no blanks) passes the mod 97 check."""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97) == 1


def _valid(kind: str, text: Column) -> Column:
    number = digits(text)
    if kind == "ip":
        return text.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return let(number, lambda n: F.when(F.length(n).between(14, 19), luhn(n)).otherwise(False))
    if kind == "phone":
        return F.length(number).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(text, F.lit(" "), F.lit("")))
    return F.lit(True)


def _needs(kind: str, text: Column) -> Column:
    """A cheap test that spares texts without the kind the fencing."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike("[0-9]")


def _spans(kind: str, text: Column) -> Column:
    """Array of confirmed ``(start, kind number, end, score, value)`` of one kind."""
    pieces = F.split(F.regexp_replace(text, PATTERNS[kind], f"{_MARK}$0{_MARK}"), _MARK)

    def build(p: Column) -> Column:
        def all_of(before: Column) -> Column:
            def one(k: Column) -> Column:
                i = (k * 2 + 1).cast("int")
                near = F.lower(F.concat(F.right(F.get(p, i - 1), F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(F.get(p, i + 1), F.lit(CONTEXT_CHARS // 2))))
                score = F.lit(START[kind]) + F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})"), 0.2).otherwise(0.0)
                return F.struct(
                    F.get(before, i).alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                    (F.get(before, i) + F.length(F.get(p, i))).alias("end"),
                    F.round(F.least(score, F.lit(1.0)), 3).alias("score"), F.get(p, i).alias("value"),
                )

            return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 3) / 2).cast("int")), one)

        found = let(sums_before(F.transform(p, lambda x: F.length(x))), all_of)
        return F.filter(found, lambda s: _valid(kind, s["value"]) & (F.lit(KINDS.index(kind) < BASE_KINDS) | (s["score"] >= MIN_SCORE)))

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,score:double,value:string>>")
    filled = let(pieces, lambda p: F.when(F.size(p) >= 3, build(p)).otherwise(none))
    return F.when(_needs(kind, text), filled).otherwise(none)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``pii``: the confirmed spans of every row by start, then kind."""
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), _MARK, _OTHER)
    staged = docs.withColumn("_pii_text", clean)
    for k in KINDS:
        staged = staged.withColumn(f"_pii_{k}", _spans(k, F.col("_pii_text")))
    return staged.withColumn("pii", F.array_sort(F.concat(*[F.col(f"_pii_{k}") for k in KINDS]))).drop("_pii_text", *[f"_pii_{k}" for k in KINDS])


def described(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores(spans: Column) -> Column:
    """Scores of all spans in hundredths, joined by commas in the order of :func:`described`."""
    return F.array_join(F.transform(spans, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``text`` with every confirmed span replaced by its kind in angle brackets.

    Spans that overlap an earlier one are covered by the replacement of that one.
    """
    found = find(docs, text)
    body = F.coalesce(F.col(text), F.lit(""))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        kept = F.substring(F.col("_body"), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        more = F.array_append(F.array_append(state["out"], kept), F.get(names, s["kind"]))
        return F.when(s["start"] < state["at"], F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), more.alias("out")))

    end = lambda state: F.concat(F.array_join(state["out"], ""), F.substring(F.col("_body"), (state["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return found.withColumn("_body", body).withColumn(text, F.aggregate("pii", start, step, end)).drop("_body", "pii")
