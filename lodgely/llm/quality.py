"""Quality rules: each is evaluated once into a ledger of failure bits and measurements; policies and ablations read the ledger."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, released, small_arrow_batches, text_rows, written
from .periods import numbered

#: What is measured of a text, all long: see measure().
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters", "n_capitals", "n_digits")
SYMBOLS, BLANKS, WINDOW = "#*$%&|<>", " \t\n\v\f\r", 5


@dataclass(frozen=True)
class Rule:
    """A bit of the ledger; `fails` is SQL over the measurements. A bit keeps its meaning for ever: a changed rule gets a new one."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "stutters", "100 * n_stutters > 20 * n_words"),
    Rule(4, "capitals", "100 * n_capitals > 30 * n_words"),
    Rule(5, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(6, "short_words", "word_chars < 3 * n_words"),
    Rule(7, "long_words", "word_chars > 12 * n_words"),
    Rule(8, "digits", "100 * n_digits > 30 * word_chars"),
)


@dataclass(frozen=True)
class Policy:
    """A version of what to keep: texts that fail no rule of `reject` and fewer than `most` of `doubt`."""

    version: str
    reject: tuple[str, ...]
    doubt: tuple[str, ...] = ()
    most: int = 2


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("1", (*BASE.reject, "symbols")), Policy("2", (*BASE.reject, "symbols", "stutters", "capitals"), ("repeated_lines", "short_words", "long_words", "digits")))}
CURRENT = POLICIES["2"]


def _repeat_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words in windows of `width` words that stand twice or more in the text."""
    if len(ids) < 2 * width - width + 1:
        return 0
    ranks, size = ids, 1
    while size < width:
        step = min(size, width - size)
        ranks, size = np.unique(ranks[:-step] * np.int64(len(ids) + 1) + ranks[step:], return_inverse=True)[1], size + step
        if len(ranks) == int(ranks.max()) + 1:
            return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    twice = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    edge[twice] += 1
    np.add.at(edge, twice + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """MEASURES of a text: words and their code points, characters of SYMBOLS, lines (by \\n) with a word and those equal to an earlier one, words in repeated windows of five, words equal to the one before, words of two or more letters in capitals alone, digits 0 to 9."""
    ids, words = numbered(text.encode())
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    capital = np.array([len(w) > 1 and w.isupper() for w in (w.decode() for w in words)], bool)
    return (
        len(ids), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), _repeat_words(ids),
        int((ids[1:] == ids[:-1]).sum()), int(capital[ids].sum()) if len(ids) else 0, sum(map(text.count, "0123456789")),
    )


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (their columns, or `keep`) with MEASURES of each whole text; a null text is an empty one. Columns of docs with these names are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in MEASURES]
    small_arrow_batches(docs.sparkSession)
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_rule_text"))
    schema = docs.select(*keep, *[F.lit(0).cast("long").alias(m) for m in MEASURES]).schema
    shape = pa.schema([(m, pa.int64()) for m in MEASURES])

    def run(batches):
        for batch in batches:
            own, lo = batch.select(keep), 0
            for out in in_batches((measure(t) for (t,) in text_rows([batch], "_rule_text")), shape):
                part, lo = own.slice(lo, out.num_rows), lo + out.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, *out.columns], names=[*keep, *MEASURES])

    return rows.mapInArrow(lambda batches: released(run(batches)), schema)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (their columns, or `keep`) with MEASURES and `failed`, a long with the bit of each rule that fails; a written table, so texts are read once for all policies.

    A null or empty text has no words. Very long texts are measured whole by one task. Repeated rows and null ids are rows
    like others, an empty table gives an empty one, and columns of docs named like the new ones are replaced. Every rule
    has a value for every row, as measurements are never null; a measurement that equals a limit does not fail.
    """
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("long") for r in rules]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return written(measured(docs, text, keep).withColumn("failed", total), "ledger")


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    """The bits of some rules; an unknown name is an error."""
    known = {r.name: r.bit for r in rules}
    return sum(1 << known[n] for n in names)


def _fails(failed: Column, reject: Column, doubt: Column, most: int) -> Column:
    return (failed.bitwiseAND(reject) != 0) | (F.bit_count(failed.bitwiseAND(doubt)) >= most)


def kept(policy: Policy, failed: str = "failed", rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a policy keeps a row of the ledger."""
    bits = lambda names: F.lit(mask(names, rules)).cast("long")
    return ~_fails(F.col(failed), bits(policy.reject), bits(policy.doubt), policy.most)


def failed_rules(failed: str = "failed", rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules whose bits are set, by bit."""
    return F.array_compact(F.array(*[F.when(F.col(failed).bitwiseAND(F.lit(1 << r.bit)) != 0, F.lit(r.name)) for r in sorted(rules, key=lambda r: r.bit)]))


def patterns(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows and words of each value of `failed` (and of the columns `by`): all that ablations need, one row for each set of rules that fail together."""
    return rows.groupBy(*by, "failed").agg(F.count("*").alias("rows"), F.sum("n_words").alias("words"))


def ablations(rows: DataFrame, policy: Policy = CURRENT, by: tuple[str, ...] = (), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy (and values of `by`): rows and words in all, those that fail the rule, those that the policy keeps, and those it would keep without the rule.

    From patterns() of a ledger, so texts and rows are not gone through again: each pattern meets each rule once.
    """
    own = [r for r in rules if r.name in policy.reject + policy.doubt]
    all_reject, all_doubt = mask(policy.reject, rules), mask(policy.doubt, rules)
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in own])).alias("r")
    met = patterns(rows, by).select("*", each)
    without = lambda m: F.lit(m).cast("long").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    now, then = kept(policy, rules=rules), ~_fails(F.col("failed"), without(all_reject), without(all_doubt), policy.most)
    sums = {"": F.lit(True), "failed_": F.col("failed").bitwiseAND(F.col("r.bit")) != 0, "kept_": now, "without_": then}
    return met.groupBy(*by, "r.rule").agg(*[F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(n + c) for n, ok in sums.items() for c in ("rows", "words")])


def rule_spread(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Per values of `by`: rows, and the rules that some row (`some_fail`) and that every row (`all_fail`) fails, by bitwise aggregation."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.bit_or("failed").alias("some_fail"), F.bit_and("failed").alias("all_fail"))


def op13_rules(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, the base measurements, base_failed, kept (by the current policy), and the ledger's bits, their names and the policy's version. See ledger() for nulls, long texts, repeats and empty tables."""
    rows = ledger(docs.select("doc_id", "text"), keep=["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~kept(BASE)).alias("base_failed"), kept(CURRENT).alias("kept"), "failed", F.array_join(failed_rules(), ",").alias("failed_rules"), F.lit(CURRENT.version).alias("policy"))


#: The query as DuckDB SQL.
ORACLE_SQL = r"""
with docs as (select row_number() over () as n, doc_id, coalesce(text, '') as t from documents),
w as (select n, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from docs),
grams as (select n, i, list_slice(ws, i, i + 4) as gram from (select n, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
twice as (select n, gram from grams group by n, gram having count(*) > 1),
places as (select distinct n, i + k as place from (select g.n, g.i, unnest(range(5)) as k from grams g join twice using (n, gram))),
repeats as (select n, count(*) as n_repeat_words from places group by n),
m as (
  select w.n, doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols,
    len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) as n_stutters,
    len(list_filter(ws, lambda x: length(x) > 1 and x = upper(x) and x <> lower(x))) as n_capitals, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) as n_digits
  from w left join repeats using (n)),
bits as (
  select *, (n_words < 10)::bigint + 2 * (100 * n_repeat_words > 20 * n_words)::bigint + 4 * (100 * n_symbols > 10 * n_words)::bigint + 8 * (100 * n_stutters > 20 * n_words)::bigint
    + 16 * (100 * n_capitals > 30 * n_words)::bigint + 32 * (100 * n_dup_lines > 30 * n_lines)::bigint + 64 * (word_chars < 3 * n_words)::bigint + 128 * (word_chars > 12 * n_words)::bigint + 256 * (100 * n_digits > 30 * word_chars)::bigint as failed
  from m)
select doc_id, n_words::bigint as n_words, word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, failed & 3 <> 0 as base_failed,
  failed & 31 = 0 and bit_count(failed & 480) < 2 as kept, failed,
  array_to_string(list_filter([case when failed & 1 <> 0 then 'few_words' end, case when failed & 2 <> 0 then 'repeated_windows' end, case when failed & 4 <> 0 then 'symbols' end, case when failed & 8 <> 0 then 'stutters' end,
    case when failed & 16 <> 0 then 'capitals' end, case when failed & 32 <> 0 then 'repeated_lines' end, case when failed & 64 <> 0 then 'short_words' end, case when failed & 128 <> 0 then 'long_words' end, case when failed & 256 <> 0 then 'digits' end], lambda x: x is not null), ',') as failed_rules,
  '2' as policy
from bits
"""
