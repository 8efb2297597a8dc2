"""Column expressions over descriptions, amounts and dates. All are built-in functions; nulls count as empty."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def clean_cell(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _first(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case that holds; null if none does."""
    return F.coalesce(*[F.when(test, value) for test, value in cases])


def mode_by_prefix(description: Column) -> Column:
    """Payment mode by an anchored prefix of the description, in either case; null if none fits."""
    return _first([(description.rlike(f"(?i){p}"), F.lit(m)) for m, p in rules.MODE_PREFIXES.items()])


def mode_by_word(description: Column) -> Column:
    """Payment mode by the first word of the description; null if none fits."""
    return _first([(description.rlike(f"(?i){p}"), F.lit(m)) for m, p in rules.MODE_WORDS.items()])


def stripped(description: Column) -> Column:
    """The description without handles, noise words and long numbers, each replaced by a blank."""
    out = F.regexp_replace(F.coalesce(description, F.lit("")), f"(?i){'|'.join(rules.HANDLES)}", " ")
    return F.regexp_replace(out, rf"(?i)\b(?:{'|'.join(rules.NOISE_WORDS)})\b|{rules.LONG_NUMBER}", " ")


def candidate(description: Column) -> Column:
    """What may name a merchant: tokens that are no routing code, no number and longer than one character."""
    tokens = F.transform(F.split(stripped(description), rules.TOKEN_BREAKS), F.trim)
    routing = F.array(*map(F.lit, rules.ROUTING))
    kept = F.filter(tokens, lambda t: (F.length(t) > 1) & ~F.array_contains(routing, F.upper(t)) & ~t.rlike(r"^\d+$"))
    return F.trim(F.regexp_replace(F.array_join(kept, " "), r"\s+", " "))


def _names() -> tuple[Column, Column]:
    aliases = F.create_map(*[F.lit(x) for kv in rules.ALIASES.items() for x in kv])
    names = F.create_map(*[F.lit(x) for m in rules.MERCHANTS for x in (m.upper(), m)])
    return aliases, names


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def canonical(found: Column) -> Column:
    """struct(merchant, confidence): of the whole candidate, else of its first word with a name; null fields if none."""
    aliases, names = _names()
    lookup = lambda c: F.coalesce(F.try_element_at(aliases, c), F.try_element_at(names, c))
    sure = lambda name, by: F.struct(name.alias("merchant"), F.when(name.isNotNull(), F.lit(rules.CONFIDENCE[by])).cast("double").alias("confidence"))

    def of(upper: Column) -> Column:
        word = lambda: _let(F.get(F.filter(F.transform(F.split(upper, " "), lookup), F.isnotnull), F.lit(0)), lambda w: sure(w, "word"))
        return _let(lookup(upper), lambda w: F.when(w.isNotNull(), sure(w, "alias")).otherwise(word()))

    return _let(F.upper(found), of)


def titled(c: Column) -> Column:
    """Every letter after a non-letter in upper case, the others in lower case."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"[^\p{L}]*\p{L}*"), F.lit(0)), lambda p: F.concat(F.regexp_extract(p, r"^[^\p{L}]*", 0), F.initcap(F.regexp_extract(p, r"\p{L}*$", 0)))), "")


def merchant_of(description: Column) -> Column:
    """struct(merchant, confidence, cleaned) by exact names, then words, then the candidate in title case."""
    row = lambda merchant, sure, found: F.struct(merchant.alias("merchant"), sure.alias("confidence"), found.alias("cleaned"))

    def of(found: Column) -> Column:
        named = _let(canonical(found), lambda n: row(F.coalesce(n["merchant"], titled(found)), F.coalesce(n["confidence"], F.lit(rules.CONFIDENCE["fallback"])), found))
        return F.when(found == "", row(F.lit(None).cast("string"), F.lit(0.0), found)).otherwise(named)

    return _let(candidate(description), of)


def _keyword_pattern() -> str:
    """At each place the keyword that goes first of those that begin there; keywords of one first letter stand together."""
    by_letter: dict[str, list[str]] = {}
    for k, _ in rules.keywords_by_length():
        by_letter.setdefault(k[0], []).append(re.escape(k[1:]))
    return f"(?=({'|'.join(f'{x}(?:{chr(124).join(rest)})' for x, rest in by_letter.items())}))"


def keyword_category(text: Column) -> Column:
    """Category of the first keyword, longest first, that is part of the text in lower case; null if none is. Reads the text once."""
    ranks = {k: i for i, (k, _) in reversed(list(enumerate(rules.keywords_by_length())))}
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_keyword_pattern()), F.lit(1))
    names = F.array(*[F.lit(c) for _, c in rules.keywords_by_length()])
    return F.get(names, F.array_min(F.transform(F.array_distinct(found), lambda k: F.element_at(rank, k))))


def ruled_category(merchant: Column, description: Column, code: Column | None = None) -> Column:
    """struct(category, confidence) by merchant, code or keyword; null fields if no rule holds."""
    by_merchant = F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.MERCHANT_CATEGORIES.items() for x in kv]), merchant)
    codes = F.create_map(*[F.lit(x) for c, ns in rules.CATEGORY_CODES.items() for n in ns for x in (n, c)])
    by_code = F.try_element_at(codes, code) if code is not None else F.lit(None).cast("string")
    # Tried in order, each once: keywords are the dear ones, so they come in where nothing else holds.
    rule = lambda found, sure: F.when(found.isNotNull(), F.struct(found.alias("category"), F.lit(sure).cast("double").alias("confidence")))
    by_word = F.get(F.transform(F.array(keyword_category(F.concat_ws(" ", merchant, description))), lambda c: rule(c, rules.CONFIDENCE["keyword"])), F.lit(0))
    none = F.struct(F.lit(None).cast("string").alias("category"), F.lit(None).cast("double").alias("confidence"))
    return F.coalesce(rule(by_merchant, rules.CONFIDENCE["merchant"]), rule(by_code, rules.CONFIDENCE["code"]), by_word, none)


#: All that reads as a decimal: a cast that fails is dear.
_NUMBER = r"^[\x00-\x20\p{Z}]*[+-]?(?:\p{Nd}+\.?\p{Nd}*|\.\p{Nd}+)(?:[eE][+-]?\p{Nd}+)?[\x00-\x20\p{Z}]*$"


def number(c: Column, kind: str) -> Column:
    """The decimal that a text shows; null if it shows none or one that ``kind`` does not hold."""
    return F.when(c.rlike(_NUMBER), c.try_cast(kind))


def amount(c: Column) -> Column:
    """decimal(18,2); null for blank, ``nan``, ``none``, ``-`` and for what is no number (see ``bad_amount``)."""
    v = clean_cell(c)
    return number(F.translate(v, ",₹", ""), "decimal(18,2)")


def bad_amount(c: Column) -> Column:
    """Whether a cell holds something that should be an amount and is none."""
    v = clean_cell(c)
    return F.when((v == "") | amount(c).isNotNull(), False).otherwise(~F.lower(v).isin("nan", "none", "-"))


#: Months by the first three letters of their names, and two-digit years from here on are of the last century.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
CENTURY = 75
_DAY_NAME = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?[,.]?\s+)?"
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_TIME = r"(?:[\st,]+(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.\d+)?)?\s*(am|pm|)\s*(?:z|utc|gmt|[+-]\d\d:?\d\d)?)?$"
#: Kinds of date: a pattern, and which of its groups are year, month and day.
_DATES = {
    "iso": (rf"^{_DAY_NAME}(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}", (1, 2, 3)),
    "plain": (rf"^(\d{{4}})(\d\d)(\d\d){_TIME}", (1, 2, 3)),
    "day": (rf"^{_DAY_NAME}(\d{{1,2}})[-/. ](\d{{1,2}})[-/. ](\d{{2}}|\d{{4}}){_TIME}", (3, 2, 1)),
    "named": (rf"^{_DAY_NAME}(\d{{1,2}})(?:st|nd|rd|th)?[-/., ]*{_MONTH}[-/., ]*(\d{{4}}|\d{{2}}){_TIME}", (3, 2, 1)),
    "month": (rf"^{_DAY_NAME}{_MONTH}[-/. ]*(\d{{1,2}})(?:st|nd|rd|th)?[-/., ]+(\d{{4}}|\d{{2}}){_TIME}", (3, 1, 2)),
}


def statement_date(c: Column, compat: bool = False) -> Column:
    """timestamp_ntz of a date in figures or with the name of a month, with or without a time; null if it reads as none.

    ISO dates stay ISO; others are day first, and month first where only that is a date. Two-digit years are those from
    1900 + ``CENTURY`` on. Names of days and zones are passed over. ``compat`` reads ISO dates with day and month exchanged
    where that is a date.
    """

    def of(v: Column) -> Column:
        def read(kind: str) -> Column:
            pattern, (year, month, day) = _DATES[kind]
            # All groups from one match; what may follow it is the last part.
            line = F.split(F.regexp_replace(v, pattern, f"${year}|${month}|${day}|$4|$5|$6|$7|"), r"\|")
            return F.when(v.rlike(pattern), _let(line, lambda parts: timed(kind, parts)))

        def timed(kind: str, parts: Column) -> Column:
            year, month, day = 1, 2, 3
            part = lambda k: F.get(parts, F.lit(k - 1))
            number = lambda k: F.when(part(k) != "", part(k).try_cast("int")).otherwise(0)
            y = number(year) + F.when(F.length(part(year)) == 2, F.when(number(year) < CENTURY, 2000).otherwise(1900)).otherwise(0)
            m = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(part(month), 1, 3)).cast("int") if kind in ("named", "month") else number(month)
            half = part(7)
            hour = F.when(half == "", number(4)).otherwise(number(4) % 12 + F.when(half == "pm", 12).otherwise(0))
            made = lambda mm, dd: F.try_make_timestamp_ntz(y, mm, dd, hour, number(5), number(6).cast("decimal(8,6)"))
            tries = {"iso": [made(number(day), m), made(m, number(day))] if compat else [made(m, number(day))], "day": [made(m, number(day)), made(number(day), m)]}.get(kind, [made(m, number(day))])
            return F.coalesce(*tries)

        return F.coalesce(*map(read, _DATES))

    # The commonest form needs no pattern with groups.
    v = clean_cell(c)
    y, a, b = (F.substring(v, i, n).try_cast("int") for i, n in ((7, 4), (1, 2), (4, 2)))
    made = lambda mm, dd: F.try_make_timestamp_ntz(y, mm, dd, F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))
    return F.when(v.rlike(r"^[0-9]{2}[-/][0-9]{2}[-/][0-9]{4}$") & (F.length(v) == 10), F.coalesce(made(b, a), made(a, b))).otherwise(_let(F.lower(v), of))


# Banks by words in a text (first bank with any), layouts by column words.
BANKS = {
    "SBI": ["state bank of india", "sbi", "sbin"],
    "Canara Bank": ["canara bank", "canara"],
    "HDFC Bank": ["hdfc bank", "hdfc"],
    "ICICI Bank": ["icici bank", "icici"],
    "Axis Bank": ["axis bank", "axis"],
    "PNB": ["punjab national bank", "pnb"],
}


def bank_of(text: Column, banks: dict[str, list[str]] | None = None) -> Column:
    """First bank, in order, any of whose words is part of the text in lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    cases = []
    for bank, words in (banks or BANKS).items():
        test = F.lit(False)
        for w in words:
            test = test | F.contains(low, F.lit(w))
        cases.append((test, F.lit(bank)))
    return _first(cases)


def layout_hint(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda w: F.contains(low, F.lit(w))
    return (
        F.when(has("debit") & has("credit"), "dual_amount_columns").when(has("withdrawal") | has("deposit"), "withdrawal_deposit_columns")
        .when(has("particulars") | has("narration"), "narration_table").otherwise("generic_table")
    )
