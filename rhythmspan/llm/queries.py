"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, divergence, language, mixing, packing, quality, rollup, sharding, simhash, suffix_dedup, toxicity, whitening, winnowing
from ._common import shared_dir, staged, table

SHARDS = 40


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = sharding.with_size(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32")
    return sharding.assign_shards(docs, SHARDS).withColumn("law", F.lit("key"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_likeness(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter; documents of low quality leave; then counts are revised with digit runs read as one digit."""
    import uuid

    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    low = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    shorter = F.regexp_replace("text", "[0-9]+", "0")
    first = rollup.count_tokens(docs).withColumn("revised", F.lit(False))
    then = rollup.count_tokens(docs.withColumn("text", shorter)).withColumn("revised", F.lit(True))
    counts = staged(first.unionByName(then), "tokens")
    before, after = counts.where("not revised"), counts.where("revised")
    gone = before.join(low, "doc_id", "left_semi")
    stay = [c.join(low, "doc_id", "left_anti") for c in (before, after)]
    totals = rollup.TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    totals.commit("1-insert", rollup.inserts(before))
    totals.commit("2-delete", rollup.deletes(gone))
    totals.commit("2-delete", rollup.deletes(gone))  # a replay counts once
    totals.commit("3-revise", rollup.revisions(*stay))
    return totals.totals()


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).withColumn("second_position", F.get("positions", F.lit(1))).drop("text", "source", "positions")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), *paths)
    return packed.withColumn("length", packed["length"].cast("long"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_simhash, op3_sharding, op4_winnowing, op5_decontamination, op6_token_counts, op7_mixing, op8_toxicity, op9_quality, op10_language, op11_best_fit_packing, op12_whitening, op13_source_divergence)}


#: Words as the operators count them.
WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
PIECES = r"len(regexp_extract_all({}, '\p{{L}}+|[0-9]|[^\p{{L}}0-9\x20\x09-\x0D]+'))"

OP6_SQL = f"""
with d as (select doc_id, source, lang, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[0-9]+', '0', 'g') as shorter,
                  doc_id in (select doc_id from labels where quality = 0) as low from documents),
c as (select source, lang, 'words-1' as tokenizer, {WORDS.replace("coalesce(text, '')", "shorter")} as tokens from d where not low
      union all
      select source, lang, 'pieces-2', {PIECES.format("shorter")} from d where not low)
select source, lang, tokenizer, count(*) as docs, cast(sum(tokens) as bigint) as tokens from c group by all
having count(*) <> 0 or sum(tokens) <> 0
"""

OP7_SQL = f"""
with d as (select doc_id, source, {WORDS} as size, md5(coalesce(cast(doc_id as varchar), '')) as o, text from documents),
s as (select source, sum(size) as source_size, row_number() over (order by source asc nulls last) as ord from d group by source),
w as (select *, [3, 1, 2][(ord - 1) % 3 + 1] as weight, [-0.5, 0.0, 0.5][(ord - 1) % 3 + 1] as tilt, 2 * source_size as cap from s),
l as (select *, cast(sum(source_size) over () * 1.5 - coalesce(sum(cap) over f, 0) as double) / (sum(weight) over () - coalesce(sum(weight) over f, 0)) as level
      from w window f as (order by cap / weight, ord rows between unbounded preceding and 1 preceding)),
u as (select *, cap <= level * weight as isfull from l),
c as (select max(struct_pack(r := -(cap / weight), level := level)) as m from u where not isfull),
t as (select source, source_size, tilt, case when isfull then cast(cap as double) else (select m.level from c) * weight end as target from u),
q as (select doc_id, size, source_size, target, tilt, coalesce(sum(size) over (partition by d.source order by o, size, text rows between unbounded preceding and 1 preceding), 0) as before
      from d join t on d.source is not distinct from t.source),
k as (select *, least(greatest(floor(target) - before, 0), size) + least(greatest(floor(target) - before - source_size, 0), size) as taken,
      least(greatest(floor(target) - before - source_size, 0), size) as again, least((before + source_size) / case when target > 0 then target end, 1.0) as share2,
      least(before / case when target > 0 then target end, 1.0) as share from q)
select doc_id, size, cast(source_size as bigint) as source_size, target, cast(taken as bigint) as taken,
       case when taken > 0 then round(case when tilt = 0 then share else (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share) - (1 - tilt)) / (2 * tilt) end, 9) + 0.0 end as position,
       case when again > 0 then round(case when tilt = 0 then share2 else (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share2) - (1 - tilt)) / (2 * tilt) end, 9) + 0.0 end as second_position from k
"""


OP13_SQL = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
w as (select lang, source, id, unnest(words) as term from d),
k as (select lang, term from w group by all having count(distinct id) >= 30),
n as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by all),
l as (select lang, term, sum(n) as n from n group by all),
lt as (select lang, sum(n) as n, count(*) as v from l group by all),
gt as (select lang, source, sum(n) as n from n group by all),
g as (select lang, source, coalesce(gt.n, 0) + 5 * coalesce(v, 0) as total, coalesce(lt.n, 0) + 5 * coalesce(v, 0) as lang_total
      from (select distinct lang, source from d) left join gt using (lang, source) left join lt using (lang)),
p as (select lang, source, term, coalesce(n.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n.n, 0) + 5)) // total as p, 1 + (1000000000::hugeint * (l.n + 5)) // lang_total as q
      from g join l using (lang) left join n using (lang, source, term)),
o as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce((select sum(abs(x.p - y.p)) from p x join p y using (lang, term) where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
      from g a join g b on a.lang = b.lang and a.source <> b.source
      union all select lang, source, 'term', term, p - q from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from o)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from r where part = 'pair' or rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_token_counts": OP6_SQL, "op7_mixing": OP7_SQL, "op13_source_divergence": OP13_SQL}
