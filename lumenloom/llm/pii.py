"""PII detection and masking with DataFrame functions only.

Regular expressions propose spans, validators (octet range, Luhn, digit count, mod-97) confirm
them, and whole words in the CONTEXT_CHARS characters before and after a span, up to the next match
of its kind, raise its score. Four base kinds (email, ip, card, phone) are kept whatever their
context; three added kinds (iban, ssn, tel) need their validator or a context word to reach the
threshold. The work is linear in the text and nearly so in the number of spans.

The patterns below match what the plain patterns of the contract match, but in linear time on
any text: possessive quantifiers and look-behinds stop the engine from retrying inside a run of
characters that it has already rejected, and chains of digits that can't be a card are skipped
without becoming candidates.

Defined results: a null text is an empty text (no spans); an empty text has no spans; repeated
spans are each reported, repeated rows and rows without an id each by themselves; columns named like
the outputs are replaced; other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import let

LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
TEL = r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "tel")
CONTEXT_CHARS = 40
CONTEXT = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security"),
    "tel": ("phone", "tel", "call", "mobile", "fax"),
}
#: Score without and with a context word.
SCORES = {
    "email": (0.8, 0.95),
    "ip": (0.6, 0.8),
    "card": (0.8, 0.95),
    "phone": (0.7, 0.9),
    "iban": (0.7, 0.95),
    "ssn": (0.3, 0.8),
    "tel": (0.3, 0.7),
}
THRESHOLD = 0.5
#: Spans of one text that a running sum takes in one go.
RUN = 256
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _octets_ok(hit: Column) -> Column:
    part = lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(p.try_cast("int"), F.lit(0)) <= 255).otherwise(False)
    strip = F.transform(F.split(hit, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(strip, part)


def _mod97_ok(hit: Column) -> Column:
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code <= 57, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97).cast("int")

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0).cast("int"), step) == 1


def _digits(hit: Column) -> Column:
    return F.length(F.regexp_replace(hit, "[^0-9]", ""))


def _always(hit: Column) -> Column:
    return F.lit(True)


#: kind -> pattern, validator, a cheap test that a text can hold a match.
RULES = {
    "email": (EMAIL, _always),
    "ip": (IP, _octets_ok),
    "card": (CARD, lambda h: F.call_function("luhn_check", F.regexp_replace(h, "[ -]", ""))),
    "phone": (PHONE, lambda h: _digits(h).between(9, 15)),
    "iban": (IBAN, _mod97_ok),
    "ssn": (SSN, _always),
    "tel": (TEL, _always),
}


def _runs(of: Column) -> Column:
    """An array as an array of runs of RUN elements."""
    return let(of, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(RUN)), lambda i: F.slice(x, i, F.lit(RUN))))


def _running(numbers: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each number what the step makes of 0 and those before it: within runs first, then over the runs."""

    def each(of: Column, first: Column) -> Column:
        zero = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(of, zero, lambda acc, n: F.struct(step(acc["at"], n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def both(runs: Column) -> Column:
        totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), step))
        return F.flatten(F.zip_with(runs, each(totals, F.lit(0)), each))

    return let(_runs(numbers), both)


def _near(piece: Column, kind: str, before: bool) -> Column:
    """Whether one of the kind's context words is a whole word in the end (before a span) or the beginning of a piece of text."""
    part = F.right(piece, F.lit(CONTEXT_CHARS)) if before else F.left(piece, F.lit(CONTEXT_CHARS))
    torn = F.regexp_replace(part, r"^[\p{L}\p{N}]+" if before else r"[\p{L}\p{N}]+$", "")  # a word that the cut may have torn
    part = F.when(F.length(piece) > CONTEXT_CHARS, torn).otherwise(part)
    return F.lower(part).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(CONTEXT[kind])})(?![\p{{L}}\p{{N}}])")


def _spans(text: Column, kind: str, threshold: float) -> Column:
    """Spans of one kind: the texts between matches and the matches themselves give the offsets."""
    pattern, valid = RULES[kind]
    bare, with_context = SCORES[kind]
    edge = r"[A-Za-z0-9]" if kind == "iban" else r"[0-9-]"

    def between(hits: Column) -> Column:
        def of(gaps: Column) -> Column:
            sizes = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g["text"]) + F.length(h))
            rows = F.arrays_zip(hits.alias("hit"), _running(sizes, lambda acc, n: acc + n).alias("at"), F.slice(gaps, 1, F.size(hits)).alias("left"), F.slice(gaps, 2, F.size(hits)).alias("right"))

            def judged(x: Column) -> Column:
                start = x["at"] + F.length(x["left"]["text"])
                score = F.when(x["left"]["before"] | x["right"]["after"], F.lit(with_context)).otherwise(F.lit(bare))
                keep = valid(x["hit"])
                if kind in ADDED_KINDS:
                    keep = F.when(keep, score >= threshold).otherwise(False)
                    keep = keep & ~F.right(x["left"]["text"], F.lit(1)).rlike(edge) & ~F.left(x["right"]["text"], F.lit(1)).rlike(edge)
                return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["hit"])).alias("end"), score.alias("score"), F.coalesce(keep, F.lit(False)).alias("keep"))

            kept = F.filter(F.transform(rows, judged), lambda s: s["keep"])
            return F.transform(kept, lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "score")]))

        pieces = F.split(text, pattern, -1)
        return let(F.transform(pieces, lambda p: F.struct(p.alias("text"), _near(p, kind, True).alias("before"), _near(p, kind, False).alias("after"))), of)

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), between)).otherwise(F.array().cast(SPAN))


def find_pii(df: DataFrame, text_col: str = "text", out: str = "pii", threshold: float = THRESHOLD) -> DataFrame:
    """df plus `out`: array<struct<kind,start,end,score>>, ordered by kind as listed, then start.

    Offsets are code points, the end is exclusive.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = [_spans(text, k, threshold) for k in (*BASE_KINDS, *ADDED_KINDS)]
    return df.withColumn(out, F.concat(*parts))


def mask_pii(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with every found span replaced by its kind in angle brackets; overlapping spans merge. Null stays null."""
    tmp = "__pii_spans"
    ordered = F.array_sort(F.transform(F.col(tmp), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg_end"), s["kind"].alias("kind"))))

    def labelled(text: Column, run: Column) -> Column:
        first = F.get(run, F.lit(0))["at"]
        reach = F.substring(text, first + 1, F.element_at(run, -1)["span"]["start"] - first)
        label = lambda x: F.concat(F.lit("<"), F.upper(x["span"]["kind"]), F.lit(">"))
        cut = lambda part, at: F.transform(run, lambda x: F.concat(F.substring(part, x["at"] - at + 1, x["span"]["start"] - x["at"]), label(x)))
        return let(F.struct(reach.alias("part"), first.alias("at")), lambda r: cut(r["part"], r["at"]))

    def masked(text: Column, spans: Column, ends: Column) -> Column:
        rows = F.arrays_zip(spans.alias("span"), _running(ends, lambda acc, n: F.greatest(acc, n)).alias("at"))
        fresh = F.filter(rows, lambda x: x["span"]["start"] >= x["at"])  # `at`: where the spans before it end
        parts = F.flatten(F.transform(_runs(fresh), lambda run: labelled(text, run)))
        return F.concat(F.array_join(parts, ""), F.substr(text, F.array_max(ends) + 1))

    def replaced(text: Column) -> Column:
        return let(ordered, lambda spans: let(F.transform(spans, lambda s: -s["neg_end"]), lambda ends: masked(text, spans, ends)))

    found = find_pii(df, text_col, tmp, threshold)
    return found.withColumn(text_col, F.when(F.size(tmp) > 0, let(F.col(text_col), replaced)).otherwise(F.col(text_col))).drop(tmp)


def pii_report(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, and all spans and their scores as text."""
    tagged = find_pii(df.select("doc_id", F.col(text_col).alias("__text")), "__text", "pii", threshold)
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    return tagged.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", label), ",").alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
