"""Cleaning, tokens, n-grams, templates and class TF-IDF as column expressions and small plans."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_text(text: Column, english: bool = True) -> Column:
    """Line breaks and tabs become spaces; with ``english`` all but ASCII letters, digits and spaces go; empty becomes ``emptydoc``."""
    out = F.translate(text, "\n\t", "  ")
    if english:
        out = F.regexp_replace(out, r"[^ 0-9A-Za-z]+", "")
    # a variable of a function over one element, as a CASE over the expression would evaluate it twice
    return F.get(F.transform(F.array(out), lambda x: F.when(x == "", "emptydoc").otherwise(x)), F.lit(0))


def tokens(cleaned: Column) -> Column:
    """Lower-case words of two characters or more of a cleaned text."""
    return F.filter(F.split(F.lower(cleaned), " "), lambda w: F.length(w) >= 2)


def ngrams(words: Column, low: int, high: int) -> Column:
    """All n-grams of ``low`` to ``high`` words, joined by spaces."""

    def parts(w: Column) -> Column:
        found = [w] if low == 1 else []
        for n in range(max(low, 2), high + 1):
            starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
            found.append(_joined_slices(w, starts, n))
        return F.concat(*found)

    # a variable, as the function over the starts would evaluate the expression of the words again for each n-gram
    return F.get(F.transform(F.array(words), parts), F.lit(0))


def _joined_slices(words: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


#: ``clean_text`` and lower case on UTF-8: all bytes of other characters than ASCII go, as these do.
_PLAIN = bytes.maketrans(b"\n\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"  abcdefghijklmnopqrstuvwxyz")
_DROPPED = bytes(b for b in range(256) if not (b < 128 and chr(b).isalnum()) and b not in b" \n\t")
#: Counts that a worker holds before it sends them on.
HELD_COUNTS = 100_000


def term_counts(df: DataFrame, by: str | tuple[str, ...], text: str, english: bool = True, ngram_range: tuple[int, int] = (1, 1), together: bool = False) -> DataFrame:
    """(by, term, n). Counts add up, so the texts of a class are never concatenated. English ones are counted in Arrow batches, and
    only the sums of a batch leave it. ``together``: the counts of a class are kept in one task, which saves what goes by class another
    shuffle; for many small classes."""
    by = (by,) if isinstance(by, str) else by
    if not english:
        words = tokens(clean_text(F.col(text), english))
        return df.select(*by, F.explode(words if ngram_range == (1, 1) else ngrams(words, *ngram_range)).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("n"))
    rows = df.select(*by, F.col(text).cast("string").alias("term"))
    schema = T.StructType([*rows.schema.fields, T.StructField("n", T.LongType())])
    counted = rows.mapInArrow(lambda batches: _counted(batches, *ngram_range), schema)
    if together:
        counted = counted.repartition(*by)
    return counted.groupBy(*by, "term").agg(F.sum("n").alias("n"))


def _counted(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *keys, text = batch.columns
        held, counts = 0, {}
        for row, (key, t) in enumerate(zip(_groups(keys, len(text)), text.cast(pa.large_binary()))):
            if (t := t.as_py()) is None:
                continue
            words = (t.translate(_PLAIN, _DROPPED) or b"emptydoc").decode("ascii").split()
            if key not in counts:
                counts[key] = row, Counter()
            own = counts[key][1]
            held -= len(own)
            if high > 1:
                words = [w for w in words if len(w) > 1]
            for n in range(low, high + 1):
                own.update(words if n == 1 else map(" ".join, zip(*(words[i:] for i in range(n)))))
            held += len(own)
            if held > HELD_COUNTS:
                yield _rows_of(batch, counts)
                held, counts = 0, {}
        yield _rows_of(batch, counts)


def _groups(keys: list[pa.Array], n: int) -> Iterator:
    """For each row something that is the same in rows with the same keys, and never in others."""
    try:
        return zip(*(k.dictionary_encode().indices.to_pylist() for k in keys)) if keys else repeat((), n)
    except pa.ArrowNotImplementedError:  # of nested types
        return iter(range(n))


def _rows_of(batch: pa.RecordBatch, counts: dict) -> pa.RecordBatch:
    """A row for each term of each class. Words of one character are left out here, where they are few."""
    rows, terms, n = [], [], []
    for row, own in counts.values():
        for x in [x for x in own if len(x) < 2]:
            del own[x]
        rows += repeat(row, len(own))
        terms += own.keys()
        n += own.values()
    keys = [k.take(pa.array(rows, pa.int64())) for k in batch.columns[:-1]]
    return pa.RecordBatch.from_arrays([*keys, pa.array(terms, batch.column(batch.num_columns - 1).type), pa.array(n, pa.int64())], names=[*batch.schema.names, "n"])


def class_tfidf(counts: DataFrame, by: str, bm25: bool = False, reduce_frequent: bool = False, seeds: DataFrame | None = None) -> DataFrame:
    """``counts`` (by, term, n) with ``score`` = tf * idf.

    tf: share of the class's terms, its square root with ``reduce_frequent``. idf: ln(A / f + 1), or
    ln(1 + (A - f + 0.5) / (f + 0.5)) with ``bm25``; A is the truncated mean number of terms of a
    class, f a term's total. ``seeds``: (term, factor) multiplies the idf. Rows without class or term are left out, first
    of all, so that every use of the counts is the same plan and they are made and shuffled once.
    """
    counts = counts.where(F.col(by).isNotNull() & F.col("term").isNotNull())
    total = counts.groupBy(by).agg(F.sum("n").alias("class_total"))
    mean = total.agg(F.floor(F.avg("class_total")).alias("a"))
    freq = counts.groupBy("term").agg(F.sum("n").alias("f"))
    a, f = F.col("a"), F.col("f")
    idf = F.log(1 + (a - f + 0.5) / (f + 0.5)) if bm25 else F.log(a / f + 1)
    tf = F.col("n") / F.col("class_total")
    out = counts.join(total, by).join(freq, "term").join(F.broadcast(mean))  # one row
    if seeds is not None:
        best = seeds.groupBy("term").agg(F.max_by("factor", "rank").alias("factor")) if "rank" in seeds.columns else seeds.groupBy("term").agg(F.max("factor").alias("factor"))
        out = out.join(best, "term", "left")
        idf = idf * F.coalesce("factor", F.lit(1.0))
    return out.select(by, "term", "n", ((F.sqrt(tf) if reduce_frequent else tf) * idf).alias("score"))


def seed_factors(words: DataFrame, topics: DataFrame, multiplier: float = 2.0) -> DataFrame:
    """Seeds for ``class_tfidf``: ``multiplier`` for seed words, 1.2 for seed-topic words, which wins where both."""
    return words.select("term", F.lit(multiplier).alias("factor"), F.lit(0).alias("rank")).union(topics.select("term", F.lit(1.2).alias("factor"), F.lit(1).alias("rank")))


def top_terms(scores: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The ``n`` best terms of each class with ``rank``; ties by term. A class with fewer terms has fewer rows: there are no padding rows."""
    best = Window.partitionBy(by).orderBy(F.round("score", 12).desc(), "term")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def word_lists(top: DataFrame, by: str) -> DataFrame:
    """(by, words, word_scores): the terms of each class as arrays by rank."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "term", "score")))  # at most top-n a class
    return top.groupBy(by).agg(pairs.alias("p")).select(by, F.col("p.term").alias("words"), F.col("p.score").alias("word_scores"))


def topic_label(by: Column, words: Column, n: int = 4) -> Column:
    return F.concat_ws("_", by.cast("string"), F.array_join(F.slice(words, 1, n), "_"))


def fill_template(template: str, *values: Column | str) -> Column:
    """``{}`` in ``template`` replaced by the values in turn; null if one is null. A plain string is a literal."""
    parts = template.split("{}")
    if len(parts) - 1 != len(values):
        raise ValueError(f"{len(parts) - 1} places for {len(values)} values")
    out = [F.lit(parts[0])]
    for v, rest in zip(values, parts[1:]):
        out += [(F.lit(v) if isinstance(v, str) else v).cast("string"), F.lit(rest)]
    return F.concat(*out)


def prompt(df: DataFrame, template: str, values: list[Column | str], name: str = "prompt", keep: bool = True) -> DataFrame:
    """``df`` with a prompt column; without ``keep`` only that column."""
    if not isinstance(df, DataFrame) or not isinstance(template, str) or not values:
        raise ValueError("a DataFrame, a template and values are needed")
    made = fill_template(template, *values).alias(name)
    return df.withColumn(name, made) if keep else df.select(made)


def template_pattern(template: str) -> str:
    """The expression that takes a template apart: each ``{}`` is a group of anything but ``_``."""
    return "([^_]+)".join(re.escape(p).replace(r"\ ", " ") for p in template.split("{}"))


def parse_template(text: Column, template: str, names: list[str]) -> Column:
    """Struct of the parts of the first match, null without one."""
    if template.count("{}") != len(names):
        raise ValueError("as many names as places are needed")
    pattern = template_pattern(template)
    parts = F.struct(*(F.regexp_extract(text, pattern, i + 1).alias(n) for i, n in enumerate(names)))
    return F.when(text.rlike(pattern), parts)


def structs_to_string(items: Column, sep: str = " ") -> Column:
    """JSON of each struct of an array, joined."""
    return F.array_join(F.transform(items, lambda x: F.to_json(x, {"ignoreNullFields": "false"})), sep)


def endpoint_of(url: Column) -> Column:
    """The API endpoint in a service URL: after the version, or after the deployment."""
    rest = F.when(F.startswith(url, F.lit("https://")), F.regexp_replace(url, "^https://[^/]*", ""))
    plain = F.regexp_extract(rest, "^/v[0-9]+/(.+)", 1)
    deployed = F.regexp_extract(rest, "^/openai/deployments/[^/]*/([^?]+)", 1)
    return F.coalesce(F.nullif(plain, F.lit("")), F.nullif(deployed, F.lit("")))


def chat_marks() -> tuple[str, str, str]:
    """What stands before the system text, between it and the user's, and after that, in the Llama 3 instruction format."""
    mark = "<|{}|>".format
    heads = [mark("start_header_id") + role + mark("end_header_id") + "\n\n" for role in ("system", "user", "assistant")]
    return mark("begin_of_text") + heads[0], mark("eot_id") + heads[1], mark("eot_id") + heads[2]


def chat_template(system: Column, user: Column) -> Column:
    """System and user blocks, and the head of the answer."""
    before, between, after = map(F.lit, chat_marks())
    return F.concat(before, system, between, user, after)
