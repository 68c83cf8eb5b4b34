"""Quality rules as a bitmask ledger: every rule is evaluated once and leaves its measurement and a failure
bit; policies are versioned masks over the bits, and ablations are bitwise aggregations of the ledger.

Only DataFrame functions. Nothing is exploded or shuffled: words stay in arrays of their own row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import SPACE, documents

#: Three-word windows are packed for sorting as 40 hash bits and 23 position bits; longer texts sort structs.
_POSITION_BITS = 23


@dataclass(frozen=True)
class Rule:
    """A named failure predicate over the measurement columns; its place in RULES is its bit."""

    name: str
    fails: str


#: All comparisons are of integers, so that any engine gives the same bits.
RULES: tuple[Rule, ...] = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("shouting", "n_letters > 0 AND 100 * n_upper > 60 * n_letters"),
    Rule("exclamation", "100 * n_exclaim > 20 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 80 * n_lines"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
)
BIT = {rule.name: 1 << k for k, rule in enumerate(RULES)}

#: Versions of the policy: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("too_few_words", "repeated_words"),
    "v2": tuple(rule.name for rule in RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaim")


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _covered(windows: str, n: str) -> Column:
    """Word positions in three-word windows that occur twice or more, from the array of window hashes.

    Windows are sorted as (hash, position) packed into one long; equal neighbours share a hash prefix and
    are confirmed by the whole 64-bit hash. Each repeated window covers three positions from its own.
    """
    low = (1 << _POSITION_BITS) - 1
    # shiftleft drops the hash's high bits; the position takes the low ones.
    packed = f"sort_array(transform({windows}, (h, i) -> shiftleft(h, {_POSITION_BITS}) | cast(i AS bigint)))"
    same = f"shiftright(x, {_POSITION_BITS}) = shiftright({{other}}, {_POSITION_BITS}) AND {windows}[cast(x & {low} AS int)] = {windows}[cast({{other}} & {low} AS int)]"
    before, after = same.format(other="get(s, i - 1)"), same.format(other="get(s, i + 1)")
    starts = f"sort_array(transform(filter(s, (x, i) -> coalesce({before}, false) OR coalesce({after}, false)), x -> x & {low}))"
    # s and p are bound by one-element transforms, so that each is computed once
    narrow = f"transform(array({packed}), s -> {starts})[0]"
    wide = f"""transform(array(sort_array(transform({windows}, (h, i) -> struct(h AS h, cast(i AS bigint) AS i)))), s ->
        sort_array(transform(filter(s, (x, i) -> coalesce(x.h = get(s, i - 1).h, false) OR coalesce(x.h = get(s, i + 1).h, false)), x -> x.i)))[0]"""
    starts_of = f"CASE WHEN {n} < {low} THEN {narrow} ELSE {wide} END"
    total = "aggregate(p, struct(cast(-3 AS bigint) AS at, cast(0 AS bigint) AS n), (a, x) -> struct(x AS at, a.n + least(3, x - a.at) AS n), a -> a.n)"
    return F.expr(f"CASE WHEN {n} < 4 OR size(array_distinct({windows})) = size({windows}) THEN 0L ELSE transform(array({starts_of}), p -> {total})[0] END")


def ledger(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the MEASURES (long) and fail_bits (long): bit k is set when RULES[k] fails.

    A null text has no words, like an empty one: zero in every measure. Repeated rows get the same ledger
    row each. Columns of df that carry a name of the ledger's are replaced by it.
    """
    made = [*MEASURES, "fail_bits"]
    df = df.drop(*[c for c in df.columns if c in made and c != text_col])
    # columns of df that carry a name needed on the way are put aside in a struct
    aside = next(name for k in range(len(df.columns) + 1) if (name := f"__row{k}") not in df.columns)
    names, df = df.columns, df.select(F.struct(*df.columns).alias(aside), F.col(text_col).alias("__text"))
    out = df.withColumn("__t", F.coalesce(F.col("__text"), F.lit("")))
    out = out.withColumn("__w", F.filter(F.split("__t", SPACE + "+"), lambda x: x != ""))
    out = out.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_words", F.size("__w").cast("long"))
    out = out.withColumn("__h", F.expr("CASE WHEN n_words < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, cast(n_words AS int) - 3), i -> xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2))) END"))
    out = out.withColumns({
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_lines": F.size("__l").cast("long"),
        "n_upper": F.regexp_count("__t", F.lit("[A-Z]")).cast("long"),
        "n_letters": F.regexp_count("__t", F.lit("[A-Za-z]")).cast("long"),
        "n_exclaim": F.regexp_count("__t", F.lit("!")).cast("long"),
        "n_repeat_words": _covered("__h", "n_words"),
    })
    bits = " | ".join(f"CASE WHEN {rule.fails} THEN {BIT[rule.name]}L ELSE 0L END" for rule in RULES)
    out = out.withColumn("fail_bits", F.expr(bits))
    # a generator stops filters on the ledger: pushed further down they would repeat every measurement
    out = out.select(aside, F.explode(F.array(F.struct(*made))).alias("__m"))
    return out.select(*[F.col(aside)[c].alias(c) for c in names], "__m.*")


def apply_policy(ledgered: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with kept: no rule of the policy failed."""
    return ledgered.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(ledgered: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of the policy: documents that fail it, and documents that the policy rejects by it alone.

    One pass: the bits are counted by their value, a table of at most 2 ** len(RULES) rows, and each rule
    reads the values by bitwise tests. An empty ledger gives zeros.
    """
    counts = ledgered.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = ledgered.sparkSession.createDataFrame([(name, BIT[name]) for name in POLICIES[policy]], "rule string, bit bigint")
    hit = F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).cast("long")
    only = F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).cast("long")
    joined = rules.join(F.broadcast(counts), F.col("bits").bitwiseAND(F.col("bit")) != 0, "left")
    return joined.groupBy("rule").agg(hit.alias("failed"), only.alias("only_by_this_rule"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document under the newest policy."""
    out = apply_policy(ledger(documents(spark, sf_dir).select("doc_id", "text")), "v2")
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask("v1"))) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the policy rejects go; the columns stay."""
    marked = docs.withColumn("__row", F.struct(*docs.columns)).select("__row", F.col("text"))
    return apply_policy(ledger(marked), "v2").where("kept").select("__row.*")


_BITS_SQL = " + ".join(f"CASE WHEN {rule.fails} THEN {BIT[rule.name]} ELSE 0 END" for rule in RULES)
ORACLE_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g),
p AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS q FROM h WHERE c > 1) GROUP BY r),
m AS (SELECT w.r, doc_id, len(w) AS n_words, length(list_aggregate(list_prepend('', w), 'string_agg', '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(p.n, 0) AS n_repeat_words,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
             length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters,
             length(t) - length(replace(t, '!', '')) AS n_exclaim
      FROM w LEFT JOIN p USING (r)),
f AS (SELECT *, {_BITS_SQL} AS bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (bits & {mask("v1")}) <> 0 AS base_failed, (bits & {mask("v2")}) = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits
FROM f
"""
QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES = {"op2_quality_rules": ORACLE_SQL}
