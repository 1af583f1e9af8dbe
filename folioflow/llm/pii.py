"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

All of it is Spark SQL expressions. Each kind is a regular expression, read leftmost and non-overlapping; a match that its
validator refuses is dropped and not retried. An IBAN candidate has its country's length, so what stands after it is not
part of it; codes without a listed length take the longest run that no listed candidate begins in. ``email``, ``ip``, ``card`` and ``phone`` always stay; ``iban`` (mod 97) and
``ssn`` are added when their score reaches ``MIN_SCORE``: the score starts at the kind's own and gains ``CONTEXT_GAIN``
when a context word stands within ``CONTEXT`` characters of the span.

Places count code points, end exclusive. Null or empty text: no spans. A row without data keeps its text untouched.
Repeated rows and ties are independent; extra columns are kept; an empty table gives no rows. Time follows the text's size
and, for a text with very many matches, the square of their number in array copies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
CONTEXT_GAIN = 0.3
MIN_SCORE = 0.5


# characters of an account number by country (ISO 13616)
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
_UNLISTED = rf"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:(?! {_LISTED}) ?[A-Z0-9]){{11,30}}(?![A-Za-z0-9])"


@dataclass(frozen=True)
class Kind:
    """pattern: starts are tried only where a run of its first characters begins or the last match ended, which finds the same matches. maybe: a cheap test that every text with a match passes."""

    name: str
    pattern: str
    maybe: str
    score: float
    words: str
    base: bool


# fixed values: the kinds in their listed order, added kinds after them
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write|reach", True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]", 0.6, "ip|host|address|server|login|addr", True),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){11}", 0.8, "card|visa|credit|debit|pay", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.6, "phone|tel|call|mobile|fax", True),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_LISTED}|{_UNLISTED})", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2} ?[A-Z0-9]", 0.7, "iban|bank|account|konto|transfer", False),
    Kind("ssn", r"(?<![A-Za-z0-9+.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, "ssn|social|security|tax|insurance", False),
)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _mod97(s: Column) -> Column:
    """ISO 7064 check of an account number: letters count 10 to 35, the first four characters go last."""
    plain = F.replace(s, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    values = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.instr(letters, c) + 9))
    return F.aggregate(values, F.lit(0), lambda acc, v: F.when(v > 9, (acc * 100 + v) % 97).otherwise((acc * 10 + v) % 97)) == 1


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        small = lambda z: F.when(F.length(z) <= 3, z.cast("int") <= 255).otherwise(False)
        return F.forall(F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "")), small)
    if kind == "card":
        return F.length(_digits(s)).between(12, 19) & F.call_function("luhn_check", _digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    if kind == "iban":
        return _mod97(s)
    if kind == "ssn":
        return ~s.substr(1, 3).isin("000", "666") & (s.substr(1, 1) != "9") & (s.substr(5, 2) != "00") & (s.substr(8, 4) != "0000")
    return F.lit(True)


def _found(text: Column, kind: Kind, order: int) -> Column:
    """The kind's spans: gaps and matches alternate, so their running length gives each place."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    start = "struct<at:int,out:array<struct<start:int,order:int,kind:string,end:int,score:double,value:string>>>"

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        near = F.concat(F.substring(text, F.greatest(begin - CONTEXT, F.lit(0)) + 1, F.least(begin, F.lit(CONTEXT))), F.lit(" "), F.substring(text, end + 1, F.lit(CONTEXT)))
        score = F.lit(kind.score) + F.when(near.rlike(rf"(?i)(?<![a-z])(?:{kind.words})"), CONTEXT_GAIN).otherwise(0.0)
        span = F.struct(begin.alias("start"), F.lit(order).alias("order"), F.lit(kind.name).alias("kind"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score"), x["m"].alias("value"))
        ok = _valid(kind.name, x["m"])
        if not kind.base:
            ok = ok & (score >= MIN_SCORE)
        return F.struct(end.alias("at"), F.when(ok, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out")).cast(start)

    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(start), add, lambda acc: acc["out"])
    maybe = F.contains(text, F.lit(kind.maybe)) if len(kind.maybe) == 1 else text.rlike(kind.maybe)
    return F.when(maybe, spans).otherwise(F.array().cast(start.partition("out:")[2][:-1]))


def find_spans(docs: DataFrame, column: str = "text", into: str = "pii_spans") -> DataFrame:
    """docs with an array of struct<start, order, kind, end, score, value>, by start and then by kind as listed."""
    text = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    return docs.withColumn(into, F.array_sort(F.concat(*[_found(text, k, i) for i, k in enumerate(KINDS)])))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with each span in the text replaced by its kind in brackets; of overlapping spans the first holds. n_chars is set anew."""
    marked = find_spans(docs, column, "_ff_spans")
    text, spans = F.col(f"`{column}`"), F.col("_ff_spans")
    state = "struct<at:int,out:array<string>>"

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out")).cast(state)).otherwise(acc)

    rewritten = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(state), step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    out = marked.withColumn(column, F.when(F.size(spans) > 0, rewritten).otherwise(text)).drop("_ff_spans")
    return out.withColumn("n_chars", F.length(column).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
