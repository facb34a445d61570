"""Secret scans with a trigram inverted index; DataFrame functions only.

Each rule's regular expression is parsed into a Boolean query over lower-case trigrams: within a
stretch of literal text every alternative needs the trigrams that cover it, stretches are ANDed, and
alternatives ORed. The index holds (trigram, text key) postings of the trigrams that some query
uses. All posting lists are intersected at once, grouped by key, so that the list of a common trigram is
never in one task; what is left are the candidates of each rule, and only those are verified with the
expression. Rules without a mandatory trigram (such as runs of hexadecimal digits) are run over all texts.

Postings carry keys, not texts: a key is a hash of the text, and equal keys only cost a verification. The candidates
(a key and a bit per rule) are written, counted, and broadcast to the texts if they are at most BROADCAST_BYTES, so
that no text is shuffled; beyond that texts and candidates meet in a shuffled hash join on the key.

Null and empty texts have no spans. Repeated rows are each returned. ``find_secrets`` replaces a column ``spans`` (in
any case of letters); no other column is touched, and ``redact`` changes the text alone. At most 62 rules.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm._columns import free, others
from loomwork.llm._spans import add_spans, ordered
from loomwork.llm._store import later, written

EXACT_LIMIT = 64
#: 16 bytes a candidate.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Rule:
    """``valid``: SQL over the match x and group g. ``base`` rules come first in the order of kinds."""

    kind: str
    pattern: str
    valid: str = "true"
    group: int | None = None
    base: bool = False


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(g) >= 12", 2, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("forge", r"(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,})"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("login", r"[a-z][a-z0-9+]{1,9}://[^\x09-\x0D\x20:/@]*+:[^\x09-\x0D\x20:/@]{3,}+@"),
    Rule("bearer", r"(?i)bearer\x20+[A-Za-z0-9._~+/-]{20,}"),
)

#: A query: alternatives, each a set of trigrams that must all occur; None: no mandatory trigram.
Query = list[frozenset[str]] | None


def _either(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return None
    every = set(a) | set(b)
    return sorted((x for x in every if not any(y < x for y in every)), key=sorted)


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _either([x | y for x in a for y in b], [])


def _needs(strings: set[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return None
    strings = {s for s in strings if not any(t != s and t in s for t in strings)}  # the shorter alternative covers them
    return _either([frozenset(s[i : i + 3] for i in (*range(0, len(s) - 2, 3), len(s) - 3)) for s in strings], [])


def _exact(op, arg) -> set[str] | None:
    """All strings that a node matches, if they are few."""
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op is rc.IN:
        found = set()
        for kind, x in arg:
            if kind is rc.LITERAL:
                found.add(chr(x).lower())
            elif kind is rc.RANGE and x[1] - x[0] < 8:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is rc.SUBPATTERN:
        return _exact_all(arg[3])
    if op is rc.BRANCH:
        parts = [_exact_all(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is rc.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
        inner = _exact_all(arg[2])
        return None if inner is None else inner | {""}
    return None


def _exact_all(nodes) -> set[str] | None:
    strings = {""}
    for op, arg in nodes:
        more = _exact(op, arg)
        if more is None or len(strings) * len(more) > EXACT_LIMIT:
            return None
        strings = {a + b for a in strings for b in more}
    return strings


def _query(nodes) -> Query:
    found: Query = None
    strings = {""}
    for op, arg in nodes:
        more = _exact(op, arg)
        if more is not None and len(strings) * len(more) <= EXACT_LIMIT:
            strings = {a + b for a in strings for b in more}
            continue
        found, strings = _both(found, _needs(strings)), {""}
        if more is not None:
            strings = more
        elif op is rc.SUBPATTERN:
            found = _both(found, _query(arg[3]))
        elif op is rc.BRANCH:
            found = _both(found, reduce(_either, (_query(x) for x in arg[1])))
        elif op in (rc.MAX_REPEAT, rc.POSSESSIVE_REPEAT) and arg[0] > 0:
            found = _both(found, _query(arg[2]))
    return _both(found, _needs(strings))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every text with a match satisfies."""
    return _query(rp.parse(pattern))


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for part in trigram_query(r.pattern) or [] for t in part})


def build_index(df: DataFrame, key: str, text: str, trigrams: list[str]) -> DataFrame:
    """Postings (trigram number, key); a table of them serves all rules with these trigrams."""
    low = df.select(F.col(key).alias("key"), F.lower(text).alias("low"))
    has = F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)))
    return low.select(F.explode(F.array_compact(has)).alias("trigram"), "key")


def candidates(index: DataFrame, rules: tuple[Rule, ...], trigrams: list[str]) -> DataFrame:
    """Intersects postings: (key, rules), bit r for each rule whose query holds."""
    words = -(-len(trigrams) // 63)
    held = index.groupBy("key").agg(*(F.expr(f"bit_or(case when trigram div 63 = {w} then shiftleft(1L, trigram % 63) else 0L end)").alias(f"w{w}") for w in range(words)))
    bits = F.lit(0).cast("long")
    for r, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if query is None:
            continue
        masks = []
        for part in query:
            mask = [0] * words
            for t in part:
                at = trigrams.index(t)
                mask[at // 63] |= 1 << at % 63
            masks.append(" and ".join(f"(w{w} & {m}L) = {m}L" for w, m in enumerate(mask) if m))
        bits = bits.bitwiseOR(F.expr(f"case when {' or '.join(f'({m})' for m in masks)} then {1 << r}L else 0L end"))
    return held.select("key", bits.alias("rules")).where("rules != 0")


def find_secrets(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with ``spans``: array<struct<kind, rank, start, end, score>> by start, then rule order."""
    return _with_spans(df.select(*others(df.columns, "spans")), "spans", text, rules, broadcast_bytes)


def _with_spans(df: DataFrame, spans: str, text: str, rules: tuple[Rule, ...], broadcast_bytes: int) -> DataFrame:
    if len(rules) > 62:
        raise ValueError(f"{len(rules)} rules; a scan takes 62 at most")
    trigrams = vocabulary(rules)
    key, bits, *parts = free(df, "_key", "_rules", *(f"_s{r}" for r in range(len(rules))))
    keyed = df
    if trigrams:
        keyed = df.withColumn(key, F.xxhash64(text))
        found, path = written(candidates(build_index(keyed, key, text, trigrams), rules, trigrams), "candidates")
        later(path)
        side = found.select(F.col("key").alias(key), F.col("rules").alias(bits))
        side = F.broadcast(side) if 16 * found.count() <= broadcast_bytes else side.hint("shuffle_hash")
        keyed = keyed.join(side, key, "left")
    else:
        keyed = df.withColumn(bits, F.lit(0).cast("long"))
    for r, rule in enumerate(rules):
        gate = None if trigram_query(rule.pattern) is None else F.expr(f"(coalesce({bits}, 0L) & {1 << r}L) != 0")
        keyed = add_spans(keyed, parts[r], text, rule.kind, r, rule.pattern, rule.valid, gate, rule.group)
    return keyed.withColumn(spans, ordered(parts)).select(*df.columns, spans)


def redact(df: DataFrame, text: str = "text", mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with the found spans replaced by ``mask``; overlapping spans become one. All other columns stay as they are."""
    spans, cut = free(df, "_spans", "_cut")
    merged = _with_spans(df, spans, text, rules, broadcast_bytes).withColumn(
        cut,
        F.expr(
            f"""aggregate({spans}, cast(array() as array<struct<a:bigint,b:bigint>>), (acc, s) ->
            case when size(acc) > 0 and element_at(acc, -1).b >= s.start
                 then concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).a as a, greatest(element_at(acc, -1).b, s.end) as b)))
                 else concat(acc, array(struct(s.start as a, s.end as b))) end)"""
        ),
    )
    kept = f"transform({cut}, (s, i) -> substring(`{text}`, cast(case when i = 0 then 0L else element_at({cut}, i).b end as int) + 1, cast(s.a - case when i = 0 then 0L else element_at({cut}, i).b end as int)))"
    new = F.expr(f"case when size({cut}) = 0 then `{text}` else concat(array_join(transform({kept}, p -> concat(p, '{mask}')), ''), substring(`{text}`, cast(element_at({cut}, -1).b as int) + 1)) end")
    return merged.withColumn(text, new).select(*df.columns)
