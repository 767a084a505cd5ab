"""Registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from underwrite.llm import alignment, ann, common, conversation_trie, minhash, mixing, pieces, pii, quality_model, quality_rules, sharding, suffix_dedup, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(plan):
        QUERIES[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP7_SQL = rf"""
with w as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, {WORDS} as words from documents
), n as (
  select r, doc_id, text, words, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    length(regexp_replace(text, '[^a-z]', '', 'g')) as lower_letters,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) as upper_letters
  from w
), line as (
  select r, unnest(string_split(text, chr(10))) as line from w
), lines as (
  select r, sum(n) as n_lines, sum(n - 1) as n_dup_lines
  from (select r, line, count(*) as n from line where regexp_matches(line, '[^\x20\x09-\x0D]') group by r, line) group by r
), window5 as (
  select r, i, words[i:i + 4] as five from (select r, words, unnest(range(1, n_words - 3)) as i from n where n_words >= 5)
), twice as (
  select r, i from (select r, i, count(*) over (partition by r, five) as c from window5) where c > 1
), repeated as (
  select r, count(distinct i + k) as n_repeat_words from twice, (select unnest(range(5)) as k) group by r
), facts as (
  select doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_lines, 0) as n_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, lower_letters, upper_letters
  from n left join lines using (r) left join repeated using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, rejected_by is null as kept
from (
  select *, case when n_words < 10 or 100 * n_repeat_words > 20 * n_words or 10 * n_symbols > n_words
    or 10 * word_chars < 25 * n_words or word_chars > 14 * n_words or 10 * n_dup_lines > 3 * n_lines
    or 10 * upper_letters > 3 * (lower_letters + upper_letters) then 'rule' end as rejected_by
  from facts
)
"""


@query("op7_quality_rules", OP7_SQL)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_rules.assess(docs).drop("rejected_by")


OP9_SQL = r"""
with facts as (
  select doc_id, coalesce(doc_id::varchar, '') as key, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), s as (
  select *, case n % 3 when 0 then 5 when 1 then 2 else 1 end as weight from (
    select source, sum(size)::bigint as source_size, row_number() over (order by encode(source) nulls last) - 1 as n from facts group by source)
), ranked as (
  select *, sum(source_size) over () as all_size,
    sum(source_size) over (order by source_size / weight, n) - source_size as below,
    sum(weight) over () - sum(weight) over (order by source_size / weight, n) + weight as weight_left from s
), capped as (
  select *, source_size = 0 or (all_size - 3 * below) * weight > 3 * source_size * weight_left as is_full from ranked
), targets as (
  select source, source_size, case when is_full then (3 * source_size)::double else
    (weight * (all_size - sum(case when is_full then 3 * source_size else 0 end) over ()))::double
    / (sum(case when is_full then 0 else weight end) over ())::double end as target from capped
), sizes as (
  select f.source, size, count(*) as n, first(target) as target, count(*) * size as mass, floor(1000.0e0 * ln(1.0e0 + size) + 0.5e0)::bigint as m
  from facts f join targets t on f.source is not distinct from t.source where size > 0 group by f.source, size
), grown as (
  select *, sum(mass) over w - mass as above, sum(mass * m) over (partition by source) - sum(mass * m) over w + mass * m as spread
  from sizes window w as (partition by source order by size desc)
), scales as (
  select source, case when sum(case when at_cap then 0 else mass * m end) > 0 then
    (first(target) - 3 * sum(case when at_cap then mass else 0 end)::double) / sum(case when at_cap then 0 else mass * m end)::double end as scale
  from (select *, (target - 3 * above::double) * m >= 3 * spread::double as at_cap from grown) group by source
), expect as (
  select f.*, t.source_size, t.target, case when size = 0 then 0.0e0
    when scale is null or scale * floor(1000.0e0 * ln(1.0e0 + size) + 0.5e0) >= 3 then 3.0e0
    else scale * floor(1000.0e0 * ln(1.0e0 + size) + 0.5e0) end as expected,
    (('0x' || substr(md5('mix-1:' || key), 1, 13))::bigint + 0.5e0) / 4503599627370496.0e0 as u
  from facts f join targets t on f.source is not distinct from t.source left join scales c on f.source is not distinct from c.source
), odds as (
  select *, floor(expected)::bigint as whole, expected - floor(expected) as p,
    target - sum(floor(expected)::bigint * size) over (partition by source)::double as wanted from expect
), ordered as (
  select *, case when p > 0 then sum(size) over (partition by source, p > 0 order by ln(u) - ln(1.0e0 - u) + ln(1.0e0 - p) - ln(p), key) end as running
  from (select *, case when p > 0 then p end as p1 from odds)
)
select doc_id, size, source_size, target, whole + case when p > 0 and wanted > 0 and 2 * wanted > 2 * running - size then 1 else 0 end as mix_copies,
  (whole + case when p > 0 and wanted > 0 and 2 * wanted > 2 * running - size then 1 else 0 end) * size as taken
from ordered
"""


@query("op9_mixing", OP9_SQL)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents", "doc_id", "text")))


def _training(spark: SparkSession, sf_dir: str, mark: str, folds: int, held: int) -> DataFrame:
    return table(spark, sf_dir, "labels", "doc_id", mark).where(common.fold("doc_id", folds) != held)


def _judged(scored: DataFrame, folds: int, held: int, threshold: float) -> DataFrame:
    held_out = F.coalesce(common.fold("doc_id", folds) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op8_quality_model")
def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    unlabelled = docs.where(F.coalesce(common.fold("doc_id", 5) != 0, F.lit(True)))
    model = quality_model.train(unlabelled, _training(spark, sf_dir, "quality", 5, 0))
    return _judged(quality_model.score(docs, model), 5, 0, quality_model.THRESHOLD)


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    lexicon = toxicity.learn(docs, _training(spark, sf_dir, "toxic", 4, 2))
    return _judged(toxicity.score(docs, lexicon), 4, 2, toxicity.THRESHOLD)


@query("op4_minhash")
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, their number, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = pieces.encode(docs, ["doc_id", "text"], decoded="decoded")
    same = F.col("decoded").eqNullSafe(F.col("text"))
    return out.select("doc_id", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), same.alias("lossless"), "piece_ids")


OP2_SQL = """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), k as (
  select payload_digest, payload_bytes, max(page_id) as keeper from p where payload_bytes >= 1000 group by all having count(*) > 1
)
select page_id, payload_bytes, payload_digest, case when keeper <> page_id then 'revisit' else 'response' end as record_type,
  case when keeper <> page_id then keeper end as refers_to
from p left join k using (payload_digest, payload_bytes)
"""


@query("op2_warc", OP2_SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.archive(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return warc.read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_prefix_forest")
def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align(table(spark, sf_dir, "documents", "doc_id", "text"), "text", ["doc_id"])
    return out.withColumnRenamed("groups", "groups_sha256")


#: CRC-32 by the table of its byte steps, in SQL: ``crc_table`` has one row with that table as the list ``t``.
CRC_TABLE_SQL = """crc_table as (
  select list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) order by n) as t
  from (select unnest(range(256)) as n)
)"""


def crc32_sql(text: str) -> str:
    pairs = f"regexp_extract_all(hex(encode({text})), '..')"
    steps = f"list_prepend(4294967295, list_transform({pairs}, lambda h: ('0x' || h)::bigint))"
    return f"xor(list_reduce({steps}, lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295)"


def _level_sql(k: int) -> str:
    """One level of the k-d tree over three dimensions: rows{k} -> rows{k + 1}."""
    return f"""
node{k} as (
  select first, leaves, sum(size)::bigint as total, coalesce(max(d0) - min(d0), 0) as w0, coalesce(max(d1) - min(d1), 0) as w1,
    coalesce(max(d2) - min(d2), 0) as w2 from rows{k} group by first, leaves
), placed{k} as (
  select r.*, case greatest(w0, w1, w2) when w0 then d0 when w1 then d1 else d2 end as place,
    total // n.leaves * (n.leaves // 2) + (total % n.leaves * (n.leaves // 2)) // n.leaves as share
  from rows{k} r join node{k} n on r.first = n.first
), cut{k} as (
  select *, 2 * sum(size) over (partition by first order by place nulls first, doc_id nulls first, text_crc32, row_number
    rows unbounded preceding) - size <= 2 * share as goes_left from placed{k}
), rows{k + 1} as (
  select row_number, doc_id, size, text_crc32, d0, d1, d2, case when goes_left then first else first + leaves // 2 end as first,
    case when goes_left then leaves // 2 else leaves - leaves // 2 end as leaves from cut{k}
)"""


TEXT_CODE_SQL = "('0x' || rpad(substr(hex(encode({0})), 1, 12), 12, '0'))::bigint::double"

OP12_SQL = f"""
with {CRC_TABLE_SQL}, coded as (
  select row_number() over () as row_number, doc_id, strlen(coalesce(text, '')) + 1 as size, {crc32_sql("coalesce(text, '')")} as text_crc32,
    {TEXT_CODE_SQL.format("lang")} as c0, {TEXT_CODE_SQL.format("source")} as c1, n_chars::double as c2
  from documents, crc_table
), rows0 as (
  select row_number, doc_id, size, text_crc32, 0 as first, 8 as leaves,
    {", ".join(f"case when max(c{i}) over () = min(c{i}) over () then c{i} * 0 else (c{i} - min(c{i}) over ()) / (max(c{i}) over () - min(c{i}) over ()) end as d{i}" for i in range(3))}
  from coded
), {_level_sql(0)}, {_level_sql(1)}, {_level_sql(2)}
select doc_id, size, text_crc32, 'bytes' as law, first::int as shard,
  row_number() over (partition by first order by doc_id nulls first, text_crc32) - 1 as slot, null::int as grown_shard
from rows3
"""


@query("op12_kd_sharding", OP12_SQL)
def op12_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", *sharding.DIMENSIONS)
    out = sharding.partition(docs, shards=sharding.SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP11_SQL = f"""
with {CRC_TABLE_SQL}, said as (
  select conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest, length(coalesce(text, '')) as chars
  from conversations where conv_id is not null
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, digest) as pos, count(*) over (partition by conv_id) as n_own from said
), convs as (
  select conv_id, conv_id - conv_id % 100 as base, n_own, {crc32_sql("conv_id::varchar")} % 6 as h from placed, crc_table where pos = 1
), sized as (
  select c.*, least(c.h, coalesce(b.n_own, 0)) as taken from convs c left join convs b on b.conv_id = c.base
), rebuilt as (
  select c.conv_id, p.pos as depth, p.digest, p.chars from sized c join placed p on p.conv_id = c.base and p.pos <= c.h
  union all
  select c.conv_id, p.pos - c.h + c.taken, p.digest, p.chars from sized c join placed p on p.conv_id = c.conv_id and p.pos > c.h
), prefixes as (
  select conv_id, depth, chars, string_agg(digest, '') over (partition by conv_id order by depth rows unbounded preceding) as prefix from rebuilt
  union all select conv_id, 0, 0, '' from convs
), lengths as (
  select conv_id, max(depth) as depth from prefixes group by conv_id
), nodes as (
  select prefix, depth, min(conv_id) as conv_id, count(*) as n_convs, min(chars) as chars from prefixes group by prefix, depth
), ends as (
  select prefix, string_agg(conv_id::varchar, ',' order by conv_id) as ids from prefixes join lengths using (conv_id, depth) group by prefix
), children as (
  select left(prefix, 32 * (depth - 1)) as prefix, count(*) as n_children from nodes where depth > 0 group by 1
), valued as (
  select n.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * chars as saved from nodes n left join children using (prefix)
), totals as (
  select left(prefix, 32 * k) as prefix, sum((n_children = 0)::int)::bigint as n_leaves, sum(saved)::bigint as saved_tokens
  from (select *, unnest(range(0, depth + 1)) as k from valued) group by 1
)
select v.conv_id, v.depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from valued v join totals using (prefix) left join ends using (prefix) left join nodes p on v.depth > 0 and p.prefix = left(v.prefix, 32 * (v.depth - 1))
"""


@query("op11_conversation_trie", OP11_SQL)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = conversation_trie.placed_turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return conversation_trie.trie(*conversation_trie.rebuild(placed))
