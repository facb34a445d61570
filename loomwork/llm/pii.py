"""Personal data: regular expressions propose spans, checksums confirm them, context words move the score.

DataFrame functions only, one pass over the texts, no shuffle. Expressions use possessive and
anchored forms of the plain patterns, with the same matches, so that long runs cost linear time.

Base kinds (email, ip, card, phone) are kept whenever their check holds. Added kinds (iban, ssn) are
kept from ``threshold`` on: a kind's own score, plus what a checksum gives, plus CONTEXT_BONUS if a
context word stands in the CONTEXT_CHARS code points before the span. Null and empty texts have no
spans; repeated rows are each returned; a column ``spans`` (in any case of letters) is replaced, no other is touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm._columns import free, others
from loomwork.llm._spans import add_spans, ordered

CONTEXT_CHARS = 32
CONTEXT_BONUS = 0.25

_DIGITS = "regexp_replace(x, '[^0-9]', '')"
_LUHN = (
    "aggregate(split(reverse({d}), ''), struct(0 as s, 0 as i), (a, c) -> struct("
    "a.s + case when c = '' then 0 when a.i % 2 = 0 then cast(c as int) else cast(substring('0246813579', cast(c as int) + 1, 1) as int) end as s, a.i + 1 as i), a -> a.s % 10 = 0)"
).format(d=_DIGITS)
_IBAN = "replace(x, ' ', '')"
_MOD97 = (
    "aggregate(split(concat(substring({v}, 5), substring({v}, 1, 4)), ''), 0L, (a, c) -> case when c = '' then a"
    " when c <= '9' then (a * 10 + cast(c as int)) % 97 else (a * 100 + ascii(c) - 55) % 97 end) = 1"
).format(v=_IBAN)
_PART = "forall(split(x, '[.]'), p -> length(regexp_replace(p, '^0+', '')) <= 3 and cast(concat('0', substring(regexp_replace(p, '^0+', ''), 1, 3)) as int) <= 255)"


#: Characters of an IBAN by country, of the IBAN registry. A proposal ends there, not in the word that follows.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Countries by their length, where no further capital or digit follows; others with any length, up to a word's end if there is one."""
    codes = {n: "|".join(c.split()) for n, c in IBAN_LENGTHS.items()}
    rest = {n: rf"(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n in codes}
    known = "|".join(f"(?:{c})[0-9]{{2}}{rest[n]}(?![A-Z0-9])" for n, c in codes.items())
    free = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
    return rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|(?!{'|'.join(codes.values())})(?:{free}(?![A-Za-z0-9])|{free}))"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: str
    score: float
    words: tuple[str, ...]
    base: bool = True


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 0.9, ("mail", "contact")),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", _PART, 0.7, ("ip ", "address", "host")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", f"length({_DIGITS}) between 12 and 19 and {_LUHN}", 0.9, ("card", "visa", "credit")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 9 and 15", 0.6, ("tel", "phone", "call")),
    Kind("iban", _iban(), _MOD97, 0.8, ("iban", "account", "bank"), False),
    Kind("ssn", r"(?:(?<![0-9-])|\G)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "true", 0.4, ("ssn", "social security"), False),
)


def find_pii(df: DataFrame, text: str = "text", threshold: float = 0.6, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``df`` with ``spans``: array<struct<kind, rank, start, end, score>> by start, then order of kinds."""
    df = df.select(*others(df.columns, "spans"))
    out, (every, *parts) = df, free(df, "_all", *(f"_s{r}" for r in range(len(kinds))))
    for r, k in enumerate(kinds):
        out = add_spans(out, parts[r], text, k.name, r, k.pattern, k.valid, score=k.score)
    out = out.withColumn(every, ordered(parts))
    before = f"lower(substring(`{text}`, cast(greatest(y.start - {CONTEXT_CHARS}, 0L) as int) + 1, cast(least(y.start, {CONTEXT_CHARS}L) as int)))"
    found = "case " + " ".join(f"when y.rank = {r} then {' or '.join(f"contains({before}, '{w}')" for w in k.words)}" for r, k in enumerate(kinds)) + " end"
    scored = f"transform({every}, y -> struct(y.kind as kind, y.rank as rank, y.start as start, y.end as end, least(1D, y.score + case when {found} then {CONTEXT_BONUS}D else 0D end) as score))"
    kept = f"filter({scored}, y -> y.rank in ({', '.join(str(r) for r, k in enumerate(kinds) if k.base)}) or y.score >= {threshold})"
    return out.withColumn("spans", F.expr(f"case when size({every}) = 0 then {every} else {kept} end")).select(*df.columns, "spans")
