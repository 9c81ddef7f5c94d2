"""Personal data: patterns propose spans, checks confirm them, nearby words adjust their score.  DataFrame functions only.

Positions come from what lies between the matches: the text is split by the pattern, and the lengths of the pieces and
of the matches add up.  Only texts with a match are split.  Nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in the order of the spans.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
THRESHOLD = 0.75
BEFORE, AFTER = 40, 20  # code points in which words count as near
RUN = 256  # spans appended to one array before it is put away, so that long lists cost no square of their length

SPAN = "struct<kind:int,start:long,end:long,score:double,base:boolean>"
_PIECE = "struct<start:long,end:long,value:string,before:string,after:string>"


@dataclass(frozen=True)
class Rule:
    """A pattern, how its matches are checked, and their score before and beside words of ``near``.

    ``base`` spans are kept whatever their score is.  ``hint`` is a short part of every match: texts without it aren't searched.
    Repeated groups are possessive: these run in a loop, others in a recursion that a long match would overflow.
    """
    kind: str
    pattern: str
    check: str
    score: float
    near: str
    bonus: float
    hint: str
    base: bool = False


_CARD_WORDS = r"\b(?:card|credit|debit|visa|mastercard|amex|american express|karte|carte|tarjeta)\b"
_PHONE_WORDS = r"\b(?:phone|telephone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono|handy)\b"

RULES = (
    # A start inside a run of the first class can't match where the run's start doesn't, unless the last match ended there.
    Rule("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "none", 0.9,
         r"\b(?:e-?mail|mail|contact|write to)\b", 0.1, "@", True),
    Rule("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "octets", 0.8, r"\b(?:ip|address|server|host|login)\b", 0.1, r"[0-9]\.[0-9]", True),
    # the longest runs of digits with single separators, of 16 to 19 digits
    Rule("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])", "luhn", 0.8, _CARD_WORDS, 0.2, "[0-9](?:[ -]?[0-9]){3}", True),
    Rule("phone", r"\+[0-9][ ().0-9-]+[0-9]", "phone", 0.8, _PHONE_WORDS, 0.2, r"\+[0-9]", True),
    # what these lose: cards beside other numbers, shorter cards, phones that run into other numbers, phones without a country
    Rule("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])", "luhn issuer", 0.75, _CARD_WORDS, 0.2, "[0-9]{4}"),
    Rule("card", r"(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9])", "luhn issuer", 0.75, _CARD_WORDS, 0.2, "[0-9]{4}"),
    Rule("card", r"(?<![0-9])3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])", "luhn issuer", 0.75, _CARD_WORDS, 0.2, "[0-9]{4}"),
    Rule("phone", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])", "phone", 0.75, _PHONE_WORDS, 0.2, r"\+[0-9]"),
    Rule("phone", r"(?<![0-9+)-])(?<![0-9+)] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", "phone", 0.5, _PHONE_WORDS, 0.3, "[0-9]{3}[ .-][0-9]{4}"),
    Rule("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "mod97", 0.8,
         r"\b(?:iban|account|bank|konto|compte|cuenta)\b", 0.2, "[A-Z]{2}[0-9]{2}"),
    Rule("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "none", 0.5, r"\b(?:ssn|social security)\b", 0.3, "[0-9]-[0-9]{2}-[0-9]"),
)

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """Whether the check digit holds: from the right, every second digit counts twice, its digits added."""
    def worth(c: Column, i: Column) -> Column:
        v = c.cast("int")
        return F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

    return F.aggregate(F.transform(_characters(F.reverse(digits)), worth), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the number that an IBAN spells (its first four characters last, letters as 10 to 35) leaves 1 modulo 97."""
    code = F.translate(iban, " ", "")
    turned = _characters(F.concat(F.substring(code, 5, 34), F.substring(code, 1, 4)))

    def step(a: Column, c: Column) -> Column:
        v = F.instr(F.lit(_LETTERS), c) - 1
        return ((a * F.when(v > 9, 100).otherwise(10) + v) % 97).cast("int")

    return F.length(code).between(15, 34) & (F.aggregate(turned, F.lit(0), step) == 1)


def _holds(rule: Rule, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return {"none": lambda: F.lit(True), "octets": lambda: value.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"), "luhn": lambda: luhn(digits),
            "luhn issuer": lambda: digits.rlike("^[2-6]") & luhn(digits), "phone": lambda: F.length(digits).between(8, 15), "mod97": lambda: mod97(value)}[rule.check]()


def _placed(pieces: Column, found: Column) -> Column:
    """The matches with their places and what is near them, from the pieces of text before, between and behind them."""
    each = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("gap"), found.alias("value"), F.slice(pieces, 2, F.size(found)).alias("next"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), x["value"].alias("value"),
                        F.right(x["gap"], F.lit(BEFORE)).alias("before"), F.left(x["next"], F.lit(AFTER)).alias("after"))
        full = F.size(a["run"]) >= RUN
        return F.struct(end.cast("long").alias("at"), F.when(full, F.array_append(a["done"], a["run"])).otherwise(a["done"]).alias("done"),
                        F.when(full, F.array(span)).otherwise(F.array_append(a["run"], span)).alias("run"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{_PIECE}>>").alias("done"), F.array().cast(f"array<{_PIECE}>").alias("run"))
    return F.aggregate(each, start, step, lambda a: F.flatten(F.array_append(a["done"], a["run"])))


def _scored(rule: Rule, placed: Column) -> Column:
    """The spans whose check holds and, but for base ones, whose score reaches the threshold."""
    def score(x: Column) -> Column:
        near = F.lower(F.concat(x["before"], F.lit(" | "), x["after"])).rlike(rule.near)
        return F.lit(rule.score) + F.when(near, F.lit(rule.bonus)).otherwise(F.lit(0.0))

    kept = F.filter(placed, lambda x: _holds(rule, x["value"]))
    spans = F.transform(kept, lambda x: F.struct(F.lit(KINDS.index(rule.kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                                                 score(x).alias("score"), F.lit(rule.base).alias("base")))
    return spans if rule.base else F.filter(spans, lambda s: s["score"] >= THRESHOLD)


def _beside(spans: Column, more: Column) -> Column:
    """``spans`` and those of ``more`` that overlap none of them."""
    return F.concat(spans, F.filter(more, lambda s: ~F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans: an array of (kind, start, end, score, base), ordered by kind as in ``KINDS``, then by start.

    Places are code points, the end exclusive.  ``base`` marks what the plain patterns and checks find; the others were
    added, and none of them overlaps a base span of its kind or an earlier rule's.  A null text is empty and has no spans;
    rows that repeat are searched one by one; a null doc_id is kept; an empty table gives an empty result; other columns are not read.
    """
    n = range(len(RULES))
    text = F.col("text")
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    found = [F.when(text.rlike(r.hint), F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))).otherwise(none).alias(f"found{i}") for i, r in enumerate(RULES)]
    df = df.select("doc_id", "text", *found)
    pieces = [F.when(F.size(f"found{i}") > 0, F.split(text, r.pattern, -1)).otherwise(none).alias(f"pieces{i}") for i, r in enumerate(RULES)]
    df = df.select("doc_id", *[f"found{i}" for i in n], *pieces)
    df = df.select("doc_id", *[_scored(r, _placed(F.col(f"pieces{i}"), F.col(f"found{i}"))).alias(f"spans{i}") for i, r in enumerate(RULES)])
    out: dict[str, Column] = {}
    for i, r in enumerate(RULES):
        spans = F.col(f"spans{i}")
        if r.kind in out:
            spans = _beside(out[r.kind], spans)
        out[r.kind] = spans
    return df.select("doc_id", F.concat(*[F.array_sort(out[k]) for k in KINDS]).cast(f"array<{SPAN}>").alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def n_base(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == KINDS.index(kind)))).cast("long")
