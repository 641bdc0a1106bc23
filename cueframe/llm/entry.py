"""The queries of the corpus operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueframe.llm import bpe, knn, language, licenses, line_dedup, mixing, pieces, quality, resampling, simhash, toxicity, whitening, wrapper
from cueframe.llm.common import table

#: The vocabulary that op3 and the pipeline encode with.
RANKS = "byte_bpe_multi_50k.tiktoken"


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph that names a licence, with its family."""
    docs = table(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.train(spark, docs))
    return found.select("doc_id", "paragraph", "n_lines", "family", F.round("probability", 4).alias("probability"), F.round("template_match", 4).alias("template_match"), "confirmed")


#: Labelled texts of each class that the toxicity model is fitted on at most.
TOXIC_SAMPLE = 1500


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(*toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), TOXIC_SAMPLE))
    found = toxicity.severity(docs, model)
    return found.select("doc_id", F.round("severity", 6).alias("severity"), F.round("p_toxic", 6).alias("p_toxic"), "grade", "toxic")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids by their offsets, and digest both."""
    path = ranks_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.encode(docs, path, offsets_col="offsets", decoded_col="decoded", keep=["doc_id"])
    return both.select("doc_id", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.octet_length("offsets") / 8).cast("long").alias("n_pieces"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fp_hex().alias("fingerprint"), "component_id")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


#: Texts of each language that the language model is fitted on at most.
LANGUAGE_SAMPLE = 300


def language_model(docs: DataFrame) -> language.TextModel:
    return language.train(language.labelled_sample(docs, "text", "lang", LANGUAGE_SAMPLE))


def op5_source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and target of every source."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.groupBy("source").agg(F.max("source_size").alias("source_size"), F.round(F.max("target"), 3).alias("target"), F.count("*").alias("docs"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and verdict of every document; its source is its host."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language_model(docs), host=F.col("source"))
    return found.select("doc_id", "lang", F.round("probability", 6).alias("probability"), F.round("text_mean", 6).alias("text_mean"), "accepted")


def op6_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and verdict of every page, by its text, the language it
    declares, and the host, domain and suffix of its address."""
    pages = table(spark, sf_dir, "pages")
    html = F.col("html").cast("string")
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", " ")
    rows = pages.select("page_id", text.alias("text"), F.nullif(language.host_of(F.col("url")), F.lit("")).alias("host"), language.declared_in(html).alias("declared"))
    found = language.identify(rows, language_model(table(spark, sf_dir, "documents")), "page_id", host=F.col("host"), declared=F.col("declared"))
    return found.select("page_id", "lang", F.round("probability", 6).alias("probability"), F.round("text_mean", 6).alias("text_mean"), "accepted")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the weakly supervised verdict for every document."""
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op7_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base rules of every document."""
    found = quality.features(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", quality.base_failed().alias("base_failed"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of every fiftieth."""
    return knn.top_k(table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that many sites share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    clean = line_dedup.remove_spread_lines(docs, max_share=1.0)
    return clean.select("doc_id", "text", "n_lines_removed", F.length("text").cast("long").alias("n_chars"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrapper.main_text(table(spark, sf_dir, "pages"))


#: The model that op11 encodes with.
PIECES = "piece_bpe_32k.model"


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document into pieces, decode the ids, and digest both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = pieces.encode(docs, pieces_path(), decoded_col="decoded", keep=["doc_id"])
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(pieces.joined(), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, by the texts of ``benchmark`` as target."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened coordinates of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every vector is from the mean, exactly."""
    return whitening.deviations(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op5_source_targets": op5_source_targets,
    "op6_language_id": op6_language_id,
    "op6_page_language": op6_page_language,
    "op7_quality_rules": op7_quality_rules,
    "op7_base_counts": op7_base_counts,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_line_dedup": op9_line_dedup,
    "op10_html_extraction": op10_html_extraction,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_embedding_whitening": op13_embedding_whitening,
    "op13_deviations": op13_deviations,
}

ORACLE_SQL: dict[str, str] = {
    # Sources in code point order, null last, weigh 3, 1, 2; the level at which the least of weight and cap sums to the share.
    "op5_source_targets": r"""
with d as (select source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size, count(*) as docs from d group by source),
w as (select *, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w, 2.0 * source_size as most from s),
o as (select *, most / w as full_at, coalesce(sum(most) over (order by most / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as below,
  sum(w) over (order by most / w, source nulls last rows between current row and unbounded following) as above, sum(source_size) over () as total from w),
l as (select (select (1.5 * total - below) / above from o where (1.5 * total - below) / above <= full_at order by full_at, source nulls last limit 1) as level)
select source, source_size, round(least(w * coalesce(level, 0), most), 3) as target, docs from o, l""",
    "op7_base_counts": r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as pos from d),
g as (select doc_id, pos, word, case when count(*) over eight = 8 then string_agg(word, ' ') over eight end as gram from w window eight as (partition by doc_id order by pos rows between current row and 7 following)),
r as (select doc_id, pos, word, gram is not null and count(*) over (partition by doc_id, gram) > 1 as twice from g),
c as (select doc_id, pos, word, max(cast(twice as int)) over (partition by doc_id order by pos rows between 7 preceding and current row) as covered from r),
n as (select doc_id, count(*) as n_words, cast(sum(length(word)) as bigint) as word_chars, cast(sum(covered) as bigint) as n_repeat_words from c group by doc_id),
x as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
y as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from x where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(n_words, 0) < 20 or 100 * coalesce(n_repeat_words, 0) > 30 * coalesce(n_words, 0) as base_failed
from d left join n using (doc_id) left join y using (doc_id)""",
    "op8_exact_top_k": r"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (select q.vec_id as query_id, d.vec_id, cast(list_inner_product(q.v, d.v) as bigint) as score from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from p qualify rank <= 5""",
    "op9_line_dedup": r"""
with x as (select doc_id, source, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
t as (select *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as trimmed from x),
s as (select trimmed from t where trimmed <> '' group by trimmed having count(distinct coalesce(source, chr(0))) >= 10 and count(distinct text) >= 10),
k as (select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (s.trimmed is null), '') as text, count(s.trimmed) as n_lines_removed from t left join s using (trimmed) group by doc_id)
select d.doc_id, case when d.text is not null then coalesce(k.text, '') end as text, coalesce(n_lines_removed, 0) as n_lines_removed, length(case when d.text is not null then coalesce(k.text, '') end) as n_chars
from documents d left join k using (doc_id)""",
    # crc32 byte by byte, over a table that SQL makes; each distinct feature once.
    "op12_importance_resampling": r"""
with tab as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by i) as tab from (select unnest(range(256)) as i)),
x as (select 'd' as side, doc_id, text from documents union all select 'b', null, text from benchmark),
w as (select side, row_number() over () as nth, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from x),
f as (select side, nth, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as f from w),
g as (select f, hex(encode(f)) as h from (select distinct f from f)),
b as (select f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: 16 * (instr('123456789ABCDEF', h[i])) + instr('123456789ABCDEF', h[i + 1]))), lambda c, y: xor(tab[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) % 10000 as bucket from g, tab),
n as (select side, nth, bucket, count(*) as n from f join b using (f) group by all),
s as (select bucket, coalesce(sum(n) filter (side = 'd'), 0) as s, coalesce(sum(n) filter (side = 'b'), 0) as t from n group by bucket),
k as (select bucket, cast(floor(1000 * ln((t + 1.0::double) * ((select sum(s) from s) + 10000) / ((s + 1.0::double) * ((select sum(t) from s) + 10000)))) as bigint) as gain from s),
v as (select nth, cast(sum(n) as bigint) as n_features, cast(sum(n * gain) as bigint) as weight from n join k using (bucket) where side = 'd' group by nth),
o as (select doc_id, len(w) >= 20 as fits, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('42:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score from w left join v using (nth) where side = 'd'),
r as (select *, row_number() over (partition by fits order by score desc, doc_id) as nr, count(*) over (partition by fits) as fitting from o)
select doc_id, n_features, weight, score, case when fits and nr <= fitting * 5 // 100 then nr end as rank from r""",
    "op13_deviations": r"""
with v as (select vec_id, list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0),
f as (select distinct x from v),
n as (select count(*) as n from f),
s as (select i, sum(c) as s from (select unnest(x) as c, generate_subscripts(x, 1) as i from f) group by i),
t as (select list(s order by i) as s from s)
select vec_id, n, cast(list_sum(list_transform(range(1, len(s) + 1), lambda i: (n * coalesce(x[i], 0) - s[i]) ** 2)) as bigint) as deviation from v, n, t""",
}
