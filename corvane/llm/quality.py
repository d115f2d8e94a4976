"""Quality rules as a ledger: every rule is evaluated once, its failure a bit beside the measurements.

``ledger`` measures whole texts with built-in functions only, in one pass and without a shuffle; ``apply_policy`` turns the
bits into verdicts under a versioned policy, and ``ablation`` tells from bitwise aggregates alone what each rule of a policy
removes, first and by itself, without measuring again.

Defined cases: a null or empty text has no words and fails the rule on few words; ties do not arise; repeated rows give equal
rows; very long texts are measured whole, in memory that grows with their words; an empty table gives no rows; only the id and text columns are read, so other names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import table

#: The rules by bit, as SQL over the measurements: true where a text fails. Numbers of words count white-space runs apart.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 12 * n_words)",
    "marks": "2 * n_marks > n_words",
    "shouting": "10 * n_upper > 4 * word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Versioned policies: the rules whose failure rejects a text.
POLICIES = {"base": BASE, "v1": sum(BIT.values())}
_WHITE = r"[\x20\x09-\x0D]+"


def _without(text: str, chars: str) -> str:
    """How many characters of a class a text has."""
    return f"length({text}) - length(regexp_replace({text}, '{chars}', ''))"


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, failed): bit i of failed says that the text fails the i-th rule."""
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = t.select("id", "t", F.array_remove(F.split("t", _WHITE), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    # Each stage below is read twice or more by the next, so that none is computed anew for every element.
    t = t.select(
        "id", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.expr(_without("t", "[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        F.expr("2 * length(t) - length(replace(t, '!', '')) - length(replace(t, '?', ''))").cast("long").alias("n_marks"), F.expr(_without("t", "[A-Z]+")).cast("long").alias("n_upper"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "w", F.expr("if(size(w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))))").alias("h"),
    )
    # Texts with an equal pair of hashes are looked at by the words themselves: hashes only say where no window repeats.
    kept = ["id", "n_words", "word_chars", "n_symbols", "n_marks", "n_upper", "n_lines", "n_dup_lines"]
    # Only a text with an equal pair of windows is sorted.
    t = t.select(*kept, F.expr("if(size(array_distinct(h)) = size(h), cast(array() as array<struct<h:bigint,k:string,i:int>>), sort_array(transform(h, (x, i) -> struct(x as h, concat_ws(' ', get(w, i), get(w, i + 1), get(w, i + 2)) as k, i as i))))").alias("s"))
    t = t.select(*kept, F.expr("sort_array(transform(filter(transform(s, (x, k) -> struct(x.i as i, coalesce(get(s, k - 1).h = x.h and get(s, k - 1).k = x.k, false) or coalesce(get(s, k + 1).h = x.h and get(s, k + 1).k = x.k, false) as again)), x -> x.again), x -> x.i))").alias("p"))
    t = t.select(*kept, F.expr("cast(aggregate(transform(p, (x, k) -> least(3, coalesce(get(p, k + 1) - x, 3))), 0, (a, x) -> a + x) as bigint)").alias("n_repeat_words"))
    failed = sum((F.when(F.expr(rule), BIT[name]).otherwise(0) for name, rule in RULES.items()), F.lit(0))
    return t.select("*", failed.cast("long").alias("failed"))


def apply_policy(failed: Column, policy: str = "v1") -> Column:
    """True where a text is kept under a policy."""
    return failed.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """(rule, fails, alone, kept_without): from one row per failure mask, 2 to the number of rules at most."""
    mask = POLICIES[policy]
    by = led.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("m")).count()
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if b & mask])
    by = by.select("m", "count", F.explode(rules).alias("r")).select("m", "count", "r.rule", "r.bit")
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    return by.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("fails"), F.sum(F.when(F.col("m") == F.col("bit"), F.col("count")).otherwise(0)).alias("alone"),
        F.sum(F.when(F.col("m").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("count")).otherwise(0)).alias("kept_without"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, base verdict and the verdict of policy v1 for every document."""
    led = ledger(table(spark, sf_dir, "documents"))
    return led.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), apply_policy(F.col("failed")).alias("kept"), "failed",
    )


ORACLE = r"""
with t as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from t),
g as (select doc_id, w, unnest(range(len(w) - 2)) i from w where len(w) >= 3),
k as (select doc_id, i, struct_pack(a := w[i + 1], b := w[i + 2], c := w[i + 3]) k from g),
d as (select doc_id, k from k group by all having count(*) > 1),
p as (select distinct doc_id, unnest([i, i + 1, i + 2]) p from k join d using (doc_id, k)),
r as (select doc_id, count(*) n from p group by 1),
m as (select w.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
  (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words, len(l) n_lines,
  len(regexp_replace(t, '[^!?]', '', 'g')) n_marks, len(regexp_replace(t, '[^A-Z]', '', 'g')) n_upper from w left join r using (doc_id)),
f as (select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end + case when 10 * n_symbols > n_words then 4 else 0 end
  + case when 2 * n_dup_lines > n_lines then 8 else 0 end + case when n_words > 0 and (word_chars < 2 * n_words or word_chars > 12 * n_words) then 16 else 0 end
  + case when 2 * n_marks > n_words then 32 else 0 end + case when 10 * n_upper > 4 * word_chars then 64 else 0 end)::bigint failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 base_failed, failed = 0 kept, failed from f
"""
