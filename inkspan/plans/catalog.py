"""All registered queries of the engine proper, with the SQL that checks them.

The driver's tables lack tables, XBRL tags and headings, so queries for those wrap columns in markup, the same way on both sides.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkspan.functions import text as T
from inkspan.functions.decode import entities
from inkspan.operators import bpe, checks, cleaning, profile, splits
from inkspan.operators.codec import Tokenizer
from inkspan.operators.durable import durable, scratch
from inkspan.operators.vocabulary import Merges, Vocabulary
from inkspan.plans.config import Ingestion, Preparation, Tokenizer as TokenizerConfig
from inkspan.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# SQL fragments ---------------------------------------------------------------------------------------------------------

_SCRIPT = "<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"


def _gone(x: str, pattern: str, options: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', '', '{options}')"


def _count(x: str, pattern: str, options: str = "") -> str:
    return f"len(regexp_extract_all({x}, '{pattern}', 0{f", '{options}'" if options else ''}))"


def _strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x1c-\x1f\x0b]+|[\s\x1c-\x1f\x0b]+$', '', 'g')"


def _space_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    x = rf"regexp_replace({x}, '[ \t]+(\n)', '\1', 'g')"
    return _strip_sql(rf"regexp_replace({x}, ' +', ' ', 'g')")


def _artifacts_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '\nPage \d+ of \d+\n', chr(10), 'gi')"
    return rf"regexp_replace({x}, '\n\s*\d+\s*\n', chr(10), 'g')"


def _heading_sql(x: str, word: str, number: str) -> str:
    x = rf"regexp_replace({x}, '([^\n])\n({word} {number})', '\1' || chr(10) || chr(10) || '{word} \2', 'g')"
    return rf"regexp_replace({x}, '([^\n]){word} ({number})', '\1' || chr(10) || '{word} \2', 'g')"


def _hash_sql(x: str) -> str:
    return rf"sha256({_strip_sql(rf"regexp_replace(lower({_strip_sql(x)}), '[\s\x0b\x1c-\x1f]+', ' ', 'g')")})"


#: Decodes the four entities that pages of sf0.001 and sf0.01 hold.
_DECODED = "nfc_normalize(replace(replace(replace(replace(html, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '\"'), '&amp;', '&'))"


def _special_sql(x: str) -> str:
    return f"replace(replace(translate({x}, chr(160) || chr(8220) || chr(8221) || chr(8216) || chr(8217) || chr(8211) || chr(8203) || chr(8204) || chr(8205), ' \"\"''''-'), chr(8212), '--'), chr(8213), '--')"


# Cleaning --------------------------------------------------------------------------------------------------------------


@query(f"select page_id, {_DECODED} as text from pages")
def entity_decode(spark, d):
    return _read(spark, d, "pages").select("page_id", entities(F.col("html")).alias("text"))


@query(f"select page_id, {_special_sql("chr(8220) || 'a' || chr(8212) || 'b' || chr(8221) || chr(160) || chr(8203) || chr(8217) || chr(8211) || url || chr(8213)")} as text from pages")
def special_chars(spark, d):
    raw = F.concat(F.lit("“a—b” ​’–"), "url", F.lit("―"))
    return _read(spark, d, "pages").select("page_id", T.special_characters(raw).alias("text"))


@query(f"select page_id, {_gone('html', _SCRIPT, 'gis')} as text, {_count('html', _SCRIPT, 'is')}::bigint as removed from pages")
def strip_script_style(spark, d):
    c = F.col("html")
    return _read(spark, d, "pages").select("page_id", T.strip_scripts(c).alias("text"), T.count_markup(c, (T.SCRIPT,)).alias("removed"))


@query(f"select page_id, {_gone('html', '<!--.*?-->', 'gs')} as text, {_count('html', '<!--.*?-->', 's')}::bigint as removed from pages")
def strip_comments(spark, d):
    c = F.col("html")
    return _read(spark, d, "pages").select("page_id", T.strip_comments(c).alias("text"), T.count_markup(c, (T.COMMENT,)).alias("removed"))


@query(f"select page_id, {_gone(_gone('html', '<[^>]+/>'), '<[^>]+>')} as text, ({_count('html', '<[^>]+/>')} + {_count(_gone('html', '<[^>]+/>'), '<[^>]+>')})::bigint as removed from pages")
def strip_tags(spark, d):
    c = F.col("html")
    return _read(spark, d, "pages").select("page_id", T.strip_tags(c).alias("text"), T.count_markup(c, (T.EMPTY_TAG, T.TAG)).alias("removed"))


@query("select c_custkey, 'A' || c_name || ' ' || c_mktsegment || chr(10) || c_nationkey::varchar || chr(10) || 'B' || 'C' as text, 2::bigint as tables from customer")
def table_serialise(spark, d):
    raw = F.concat(F.lit("A<table border=1><tr><TD> <b>"), "c_name", F.lit("</b> </TD><th>\n"), "c_mktsegment", F.lit("</th></tr><tr></tr><tr><td>"), F.col("c_nationkey").cast("string"), F.lit("</td></tr></TABLE>B<table></table>C"))
    return _read(spark, d, "customer").select("c_custkey", T.serialise_tables(raw).alias("text"), T.count_tables(raw).alias("tables"))


@query("select o_orderkey, ' ' || o_orderkey::varchar || ' end' as text, 5::bigint as removed from orders")
def xbrl_strip(spark, d):
    raw = F.concat(F.lit("<xbrli:context id='c'>gone</xbrli:context><link:schemaRef href='xbrl.xsd'> <us-gaap:Revenue ctx='c'>"), F.col("o_orderkey").cast("string"), F.lit("</us-gaap:Revenue> <XBRLI:unit>u</XBRLI:unit>end"))
    return _read(spark, d, "orders").select("o_orderkey", T.strip_xbrl(raw).alias("text"), T.count_xbrl(raw).alias("removed"))


_HEADED = "text || chr(10) || 'ITEM 1A. Risk' || chr(10) || 'see PART II' || chr(10) || chr(10) || 'PART IV' || source"


@query(f"select doc_id, {_heading_sql(_heading_sql(_HEADED, 'PART', '[IVX]+'), 'ITEM', '[0-9A-Z]+')} as text from documents")
def structure_headings(spark, d):
    raw = F.concat("text", F.lit("\nITEM 1A. Risk\nsee PART II\n\nPART IV"), "source")
    return _read(spark, d, "documents").select("doc_id", T.headings(raw).alias("text"))


_SPACED = "'  ' || text || '  ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || source || '   x' || chr(9) || chr(10) || '   ' || chr(10)"


@query(f"select doc_id, {_space_sql(_SPACED)} as text from documents")
def whitespace_normalise(spark, d):
    raw = F.concat(F.lit("  "), "text", F.lit("  \r\n\r\n\r\n"), "source", F.lit("   x\t\n   \n"))
    return _read(spark, d, "documents").select("doc_id", T.whitespace(raw).alias("text"))


_PAGED = "text || chr(10) || 'Page 3 of 12' || chr(10) || 'more' || chr(10) || '  ' || doc_id::varchar || ' ' || chr(10) || source"


@query(f"select doc_id, {_artifacts_sql(_PAGED)} as text from documents")
def artifact_removal(spark, d):
    raw = F.concat("text", F.lit("\nPage 3 of 12\nmore\n  "), F.col("doc_id").cast("string"), F.lit(" \n"), "source")
    return _read(spark, d, "documents").select("doc_id", T.artifacts(raw).alias("text"))


@query(f"select doc_id, {_hash_sql('text')} as content_hash, length(text)::bigint as n from documents")
def dedup_hash(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.dedup_hash(F.col("text")).alias("content_hash"), F.length("text").cast("long").alias("n"))


@query(f"select doc_id, h as content_hash, doc_id <> min(doc_id) over (partition by h) as is_duplicate, case when doc_id <> min(doc_id) over (partition by h) then min(doc_id) over (partition by h) end as duplicate_of from (select doc_id, {_hash_sql('text')} as h from documents)")
def dedup_exact(spark, d):
    hashed = durable(_read(spark, d, "documents").select("doc_id", T.dedup_hash(F.col("text")).alias("content_hash")))
    found = cleaning.mark_hashed(hashed, order="doc_id", doc_id="doc_id")
    return found.select("doc_id", "content_hash", "is_duplicate", "duplicate_of")


@query(f"with h as (select doc_id, {_hash_sql('text')} as h from documents) select count(*) as total_documents, count(distinct h) as unique_documents, count(*) - count(distinct h) as duplicate_documents from h")
def dedup_stats(spark, d):
    return cleaning.dedup_statistics(dedup_exact(spark, d))


def _clean_sql() -> str:
    s1 = _gone("t0", _SCRIPT, "gis")
    s2, s3, s4 = _gone("s1", "<!--.*?-->", "gs"), _gone("s2", "<[^>]+/>"), _gone("s3", "<[^>]+>")
    headed = _heading_sql(_heading_sql("s4", "PART", "[IVX]+"), "ITEM", "[0-9A-Z]+")
    return f"""a as (select page_id, html, {_special_sql(_DECODED)} as t0 from pages),
b as (select *, {s1} as s1 from a), c as (select *, {s2} as s2 from b), e as (select *, {s3} as s3 from c), f as (select *, {s4} as s4 from e),
g as (select *, {_artifacts_sql(_space_sql(headed))} as text, ({_count("t0", _SCRIPT, "is")} + {_count("s1", "<!--.*?-->", "s")} + {_count("s2", "<[^>]+/>")} + {_count("s3", "<[^>]+>")})::bigint as removed from f),
h as (select *, {_hash_sql("text")} as content_hash from g),
i as (select page_id, text, length(html)::bigint as original_length, length(text)::bigint as cleaned_length, removed as html_elements_removed, content_hash, page_id <> min(page_id) over (partition by content_hash) as is_duplicate, case when page_id <> min(page_id) over (partition by content_hash) then min(page_id) over (partition by content_hash) end as duplicate_of from h)"""


def _cleaned_pages(spark, d):
    docs = _read(spark, d, "pages").select(F.col("page_id").alias("document_id"), F.col("page_id").alias("doc_idx"), F.col("html").alias("text"))
    return cleaning.mark_duplicates(cleaning.clean(docs))


@query(f"with {_clean_sql()} select page_id, text, original_length, cleaned_length, html_elements_removed, content_hash, is_duplicate, duplicate_of from i")
def clean_pipeline(spark, d):
    return _cleaned_pages(spark, d).select(F.col("document_id").alias("page_id"), "text", "original_length", "cleaned_length", "html_elements_removed", "content_hash", "is_duplicate", "duplicate_of")


@query(f"with {_clean_sql()} select count(*) as documents_processed, count(*) as documents_cleaned, 0::bigint as documents_failed, count(*) filter (where is_duplicate) as duplicates_detected, sum(original_length)::bigint as total_raw_characters, sum(cleaned_length)::bigint as total_cleaned_characters, sum(html_elements_removed)::bigint as html_elements_removed, 0::bigint as xbrl_elements_removed, 0::bigint as table_count, 0::bigint as encoding_issues from i")
def cleaning_report(spark, d):
    return cleaning.cleaning_report(_cleaned_pages(spark, d))


@query(f"with {_clean_sql()} select page_id, (sum(html_elements_removed) over (order by page_id))::bigint as html_elements_removed from i")
def running_counts(spark, d):
    return cleaning.running_counts(_cleaned_pages(spark, d)).select(F.col("doc_idx").alias("page_id"), "html_elements_removed")


# Statistics ------------------------------------------------------------------------------------------------------------


def _docs(spark, d):
    """Documents as prepared ones: position, id, company and date."""
    return _read(spark, d, "documents").select(F.col("doc_id").alias("doc_idx"), F.format_string("doc_%06d", "doc_id").alias("document_id"), "text", F.col("source").alias("ticker"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1461).cast("int")), "yyyy-MM-dd").alias("filing_date"))


_CHARS = "select unnest(string_split(text, '')) as character from documents"


@query(f"select character, count(*) as frequency, count(*) / sum(count(*)) over () * 100 as percentage from ({_CHARS}) where character <> '' group by character")
def char_freq(spark, d):
    return profile.with_percentage(profile.characters(_docs(spark, d)))


@query("select character, frequency from (select character, count(*) as frequency, min(doc_id * 1000000 + p) as seen from (select doc_id, unnest(string_split(text, '')) as character, unnest(range(1, len(string_split(text, '')) + 1)) as p from documents) where character <> '' group by 1) order by frequency desc, seen limit 50")
def top_characters(spark, d):
    return profile.most_common(profile.characters(_docs(spark, d), order="doc_idx"), 50).select("character", "frequency")


@query("select ('0x' || b)::int as byte, count(*) as frequency, count(*) / sum(count(*)) over () * 100 as percentage from (select unnest(regexp_extract_all(hex(encode(text)), '..')) as b from documents) group by 1")
def byte_freq(spark, d):
    return profile.with_percentage(profile.byte_values(_docs(spark, d)))


@query(f"select character, frequency, percentage, 'U+' || case when unicode(character) < 65536 then right('0000' || to_hex(unicode(character)), 4) else to_hex(unicode(character)) end as code_point from (select character, count(*) as frequency, count(*) / sum(count(*)) over () * 100 as percentage from ({_CHARS}) where character <> '' group by character) where frequency <= 1000")
def rare_chars(spark, d):
    return profile.rare_characters(profile.characters(_docs(spark, d)), 1000)


@query("with l as (select length(text)::bigint as len, row_number() over (order by length(text)) - 1 as i, count(*) over () as n from documents) select min(len) as minimum_document_length, max(len) as maximum_document_length, sum(len) / count(*) as mean_document_length, min(len) filter (where i = n // 2) as median_document_length, " + ", ".join(f"min(len) filter (where i = floor(n::double * {q}::double)) as {name}" for name, q in profile.QUANTILES.items()) + " from l")
def length_stats(spark, d):
    return profile.length_statistics(_docs(spark, d))


def _pattern_sql() -> str:
    one = lambda p, c: f"select '{p}' as pattern, sum((length({c}) - length(replace({c}, '{p}', ''))) // {len(p)})::bigint as n from documents"
    return " union all ".join([one(p, "text") for p in profile.PATTERNS] + [one(p, "lower(text)") for p in profile.TERMS])


@query(_pattern_sql())
def pattern_counts(spark, d):
    return profile.pattern_counts(_docs(spark, d))


@query("select source as ticker, count(*) as filings from documents group by 1")
def companies(spark, d):
    return profile.companies(_docs(spark, d))


@query("select count(*) as total_companies, count(*) filter (where n > 1) as companies_with_multiple_filings, max(n) as most_filings from (select count(*) as n from documents group by source)")
def company_stats(spark, d):
    return profile.company_statistics(_docs(spark, d))


@query(rf"select kind, character from (select distinct character from ({_CHARS})), (select unnest(['whitespace', 'punctuation', 'numeric']) as kind) where (kind = 'whitespace' and regexp_matches(character, '^[\s\x1c-\x1f\x0b]$')) or (kind = 'punctuation' and character <> '' and contains('.,:;%$-/()\"''&+=*', character)) or (kind = 'numeric' and character <> '' and contains('0123456789.,%', character))")
def vocabulary_candidates(spark, d):
    return profile.vocabulary_candidates(profile.characters(_docs(spark, d)))


# Splits ----------------------------------------------------------------------------------------------------------------

_CUT = "case when r < floor(n * 0.8::double) then 'train' when r < floor(n * 0.8::double) + floor(n * 0.1::double) then 'validation' else 'test' end"
_KEY = "('0x' || substr(sha256('42:' || {}), 1, 15))::bigint"
_BY_DOCUMENT = f"select doc_id, document_id, ticker, text, {_CUT} as split from (select doc_id, 'doc_' || lpad(doc_id::varchar, 6, '0') as document_id, source as ticker, text, row_number() over (order by {_KEY.format("'doc_' || lpad(doc_id::varchar, 6, '0')")}) - 1 as r, count(*) over () as n from documents)"


@query(f"select document_id, split from ({_BY_DOCUMENT})")
def split_hash_document(spark, d):
    return splits.split_documents(_docs(spark, d), Preparation("document")).select("document_id", "split")


@query(f"select doc_id, t.ticker, split from documents join (select ticker, {_CUT} as split from (select ticker, row_number() over (order by {_KEY.format('ticker')}) - 1 as r, count(*) over () as n from (select distinct source as ticker from documents))) t on t.ticker = source")
def split_hash_company(spark, d):
    return splits.split_companies(_docs(spark, d), Preparation("company")).select(F.col("doc_idx").alias("doc_id"), "ticker", "split")


@query(f"select doc_id, {_CUT} as split from (select doc_id, row_number() over (order by doc_id % 1461, doc_id) - 1 as r, count(*) over () as n from documents where source <> 'src3')")
def split_temporal(spark, d):
    """Documents of one source have no valid date, so no split has them."""
    docs = _docs(spark, d).withColumn("filing_date", F.when(F.col("ticker") != "src3", F.col("filing_date")).otherwise("no date"))
    return splits.split_temporal(docs, Preparation("temporal")).select(F.col("doc_idx").alias("doc_id"), "split")


@query()
def split_seeded_document(spark, d):
    return splits.split_seeded(_docs(spark, d), Preparation("document")).select("document_id", "split")


@query()
def split_seeded_company(spark, d):
    return splits.split_seeded(_docs(spark, d), Preparation("company"), key="ticker").select("document_id", "ticker", "split")


@query(f"select split, count(*) as documents, sum(length(text))::bigint as characters, sum(octet_length(encode(text)))::bigint as bytes, count(distinct ticker) as companies from ({_BY_DOCUMENT}) group by split")
def split_stats(spark, d):
    return profile.split_statistics(splits.split_documents(_docs(spark, d), Preparation("document")))


def _leaky(spark, d):
    """A document split in which one source's training documents are also in test."""
    placed = splits.split_documents(_docs(spark, d), Preparation("document"))
    return placed.unionByName(placed.where("split = 'train' and ticker = 'src5'").withColumn("split", F.lit("test")))


_LEAKY = f"p as (select * from ({_BY_DOCUMENT})), q as (select * from p union all select * replace ('test' as split) from p where split = 'train' and ticker = 'src5')"


def _overlaps_sql(key: str, name: str) -> str:
    pairs = [("train", "validation"), ("train", "test"), ("validation", "test")]
    return ", ".join(f"(select count(*) from (select {key} from q where split = '{a}' intersect select {key} from q where split = '{b}')) as {name}_{a}_{b}" for a, b in pairs)


@query(f"with {_LEAKY} select {_overlaps_sql('document_id', 'document')}, {_overlaps_sql('ticker', 'company')}, true as has_leakage")
def leakage_check(spark, d):
    return splits.leakage(_leaky(spark, d), ticker="ticker")


@query(f"select split, document_id from ({_BY_DOCUMENT})")
def manifest(spark, d):
    return splits.manifest(splits.split_documents(_docs(spark, d), Preparation("document")))


@query(f"with {_LEAKY} select (select count(*) from documents where length(text) < 100) as missing_documents, (select count(distinct source) from documents) as extra_documents, {_overlaps_sql('document_id', 'document').replace('from q where', 'from q where length(text) >= 100 and')}, false as is_valid")
def manifest_validate(spark, d):
    """A leaky manifest that lacks short documents and lists an unknown one for each source, held against all documents."""
    listed = splits.manifest(_leaky(spark, d).where(F.length("text") >= 100))
    ghosts = _docs(spark, d).select(F.lit("train").alias("split"), F.concat(F.lit("ghost_"), "ticker").alias("document_id")).distinct()
    return splits.validate_manifest(listed.unionByName(ghosts), _docs(spark, d))


@query("select document_id, split, length from (select 'doc_' || lpad(doc_id::varchar, 6, '0') as document_id, length(text)::bigint as length from documents) join (select document_id, split from (" + _BY_DOCUMENT + ")) using (document_id)")
def split_metadata(spark, d):
    return sinks.split_metadata(splits.split_documents(_docs(spark, d), Preparation("document"))).select("document_id", "split", "length")


# Validation and sources ------------------------------------------------------------------------------------------------


@query("select count(*) as documents, count(*) filter (where length(trim(text)) < 10) as short_documents, " + ", ".join(f"coalesce(bool_or(contains(text, '{p}')), false) as has_{i}" for i, p in enumerate(checks.EXPECTED)) + " from documents")
def corpus_facts(spark, d):
    return checks.corpus_facts(_docs(spark, d))


@query("select count(*) as documents_loaded, count(*) filter (where not failed and length(text) >= 100) as documents_valid, count(*) filter (where not failed and length(text) < 100) as documents_skipped, count(*) filter (where failed) as documents_failed, count(*) filter (where off) as length_mismatches from (select text, coalesce(quality = 0, false) as failed, source = 'src1' as off from documents left join labels using (doc_id))")
def validate_documents(spark, d):
    """Documents joined with metadata on the left; labels stand in for it."""
    meta = _read(spark, d, "labels").select(F.col("doc_id").alias("doc_idx"), F.when(F.col("quality") == 0, "failed").otherwise("success").alias("status"))
    docs = _docs(spark, d).join(meta, "doc_idx", "left").withColumn("cleaned_length", F.length("text") + F.when(F.col("ticker") == "src1", 200).otherwise(0))
    return checks.validate_documents(docs)


def _marker_file(spark, d, start: str, end: str) -> str:
    """Benchmark texts as a marker file."""
    rows = _read(spark, d, "benchmark").select("item_id", F.concat(F.lit(f"{start}\n"), "text", F.lit(f"\n{end}\n\n")).alias("v"))
    path, folder = scratch(spark), scratch(spark)
    sinks.write_parts(rows, F.col("v"), "\n", "item_id", folder)
    sinks.join_parts(spark, path, [folder])
    return path


_ITEMS = f"select row_number() over (order by item_id) as i, {_strip_sql('text')} as text from benchmark"


@query(f"select (i - 1)::bigint as doc_idx, 'doc_' || lpad((i - 1)::varchar, 6, '0') as document_id, text from ({_ITEMS})")
def marker_split_raw(spark, d):
    return files.raw_marker_file(spark, _marker_file(spark, d, "<document_start>", "<document_end>"))


@query(f"select i::bigint as part_idx, 'doc_' || lpad(i::varchar, 6, '0') as document_id, text from ({_ITEMS})")
def marker_split_prepared(spark, d):
    return files.prepared_marker_file(spark, _marker_file(spark, d, files.START, files.END))


@query(f"select i::bigint as doc_idx, text from ({_ITEMS}) where length(text) >= 300")
def marker_split_training(spark, d):
    return files.training_marker_file(spark, _marker_file(spark, d, files.START, files.END), 300)


_KEPT = "select doc_id, text, source, row_number() over (order by doc_id) - 1 as r from documents join (select min(doc_id) as doc_id from (select doc_id, " + _hash_sql("text") + " as h from documents where doc_id % 7 <> 3) group by h) using (doc_id)"


def _cleaned_folder(spark, d) -> str:
    """Documents as a cleaned folder of exports: those of a seventh failed, copies are only in the metadata."""
    docs = _docs(spark, d).where("doc_idx % 7 <> 3").select("doc_idx", "document_id", "text", "ticker", F.lit("success").alias("status"))
    found = durable(cleaning.mark_duplicates(docs).drop("content_hash"))
    folder = scratch(spark)
    sinks.write_markers(found.where("not is_duplicate"), f"{folder}/corpus.txt")
    failed = _docs(spark, d).where("doc_idx % 7 = 3").select("doc_idx", "document_id", F.lit("failed").alias("status"))
    sinks.write_lines(found.drop("text").unionByName(failed, allowMissingColumns=True), f"{folder}/metadata.jsonl", "doc_idx")
    return folder


@query(f"select 'doc_' || lpad(doc_id::varchar, 6, '0') as document_id, source as ticker, length({_strip_sql('text')})::bigint as n from ({_KEPT}) where length({_strip_sql('text')}) >= 100")
def load_cleaned_ids(spark, d):
    """Each document that was kept meets its own record, though corpus and metadata count ids in different ways."""
    return files.load_cleaned(spark, _cleaned_folder(spark, d)).select("document_id", "ticker", F.length("text").cast("long").alias("n"))


@query("select 'errors' as kind, 2 as n union all select 'warnings', (select 2 + count(*) from (values ('%'), ('$'), ('ITEM'), ('PART'), ('10-K'), ('10-Q')) t(p) where not exists (select 1 from benchmark where contains(text, p)))")
def corpus_validation(spark, d):
    """A corpus one start marker of which has no end, with a short document and too few records, and no cleaning report."""
    rows = _read(spark, d, "benchmark").select("item_id", F.concat(F.lit(f"{files.START}\n"), "text", F.lit(f"\n{files.END}\n\n")).alias("v"))
    folder, parts = scratch(spark), scratch(spark)
    sinks.write_parts(rows, F.col("v"), "\n", "item_id", parts)
    sinks.join_parts(spark, f"{folder}/corpus.txt", [parts, f"{files.START}\nshort\n{files.END}\n\n{files.START}\nno end".encode()])
    sinks.write_lines(rows.select("item_id", F.format_string("doc_%06d", F.col("item_id") + 1).alias("document_id")), f"{folder}/metadata.jsonl", "item_id")
    found = checks.validate_corpus(spark, folder)
    return spark.createDataFrame([("errors", len(found["errors"])), ("warnings", len(found["warnings"]))], "kind string, n int")


@query("select 'doc_' || doc_id as document_id, max(toxic)::bigint as cleaned_length, case when max(toxic) = 1 then 'failed' else 'success' end as status from (select doc_id, last(toxic order by quality, toxic) as toxic from labels group by doc_id) group by doc_id")
def metadata_last_wins(spark, d):
    """Two JSON lines a label, the second of which counts, and one without an id."""
    line = lambda status: F.to_json(F.struct(F.concat(F.lit("doc_"), "doc_id").alias("document_id"), F.col("toxic").alias("cleaned_length"), status.alias("status")))
    rows = _read(spark, d, "labels").select(F.explode(F.array(F.struct(F.lit(0).alias("line"), line(F.lit("draft")).alias("v")), F.struct(F.lit(1).alias("line"), line(F.when(F.col("toxic") == 1, "failed").otherwise("success")).alias("v")), F.struct(F.lit(2).alias("line"), F.lit("{}").alias("v")))).alias("x")).select("x.*")
    return files.last_records(rows).select("document_id", "cleaned_length", "status")


@query("select item_id, text || chr(10) as text from benchmark")
def discover_load(spark, d):
    """Benchmark texts written as a folder of text files, one a subfolder, and loaded in the order of their paths."""
    path = scratch(spark)
    _read(spark, d, "benchmark").select("item_id", F.col("text").alias("value")).repartition("item_id").write.partitionBy("item_id").text(path)
    found = files.load_documents(spark, path)
    return found.select(F.regexp_extract("path", r"item_id=(\d+)/", 1).cast("long").alias("item_id"), "text")


@query("select (item_id % 4)::bigint as archive_no, item_id, 'item.txt' as base_name, text from benchmark")
def zip_extract(spark, d):
    """Benchmark texts zipped by four, all members of one name, and unpacked again."""
    rows = _read(spark, d, "benchmark").withColumn("a", F.col("item_id") % 4)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for r in pdf.sort_values("item_id").itertuples():
                z.writestr(f"d{r.item_id}/item.txt", r.text)
        return pd.DataFrame({"path": [f"{pdf.a.iloc[0]}.zip"], "content": [held.getvalue()]})

    zips = rows.groupBy("a").applyInPandas(pack, "path string, content binary")
    found = files.named_members(durable(files.unpack(zips, Ingestion(extract_zip=True))))
    # names run on in the order of members: item.txt, item_1.txt...
    place = F.when(F.col("file_name") == "item.txt", 0).otherwise(F.regexp_extract("file_name", r"_(\d+)\.txt$", 1).cast("long"))
    archive = F.substring_index("archive", ".", 1).cast("long")
    return found.select(archive.alias("archive_no"), (place * 4 + archive).alias("item_id"), "base_name", files.decoded(F.col("content")).alias("text"))


@query("select (item_id // 3)::bigint as archive_no, ['f.txt', 'f_1.txt', 'f_1_1.txt'][item_id % 3 + 1] as file_name, text from benchmark")
def zip_collisions(spark, d):
    """Benchmark texts zipped by three, as f.txt, f.txt again and f_1.txt: each gets a name of its own."""
    rows = _read(spark, d, "benchmark").withColumn("a", F.expr("item_id div 3"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for r in pdf.sort_values("item_id").itertuples():
                z.writestr(f"d{r.item_id}/" + ("f_1.txt" if r.item_id % 3 == 2 else "f.txt"), r.text)
        return pd.DataFrame({"path": [f"{pdf.a.iloc[0]}.zip"], "content": [held.getvalue()]})

    found = files.named_members(durable(files.unpack(rows.groupBy("a").applyInPandas(pack, "path string, content binary"), Ingestion(extract_zip=True))))
    return found.select(F.col("stem").cast("long").alias("archive_no"), "file_name", files.decoded(F.col("content")).alias("text"))


# Tokenizer -------------------------------------------------------------------------------------------------------------


@query("select ('0x' || l)::int + 3 as \"left\", ('0x' || r)::int + 3 as \"right\", count(*) as freq from (select unnest(list_zip(b[:-2], b[2:])) as p, p[1] as l, p[2] as r from (select regexp_extract_all(hex(encode(text)), '..') as b from documents)) where r is not null group by 1, 2")
def byte_pair_counts(spark, d):
    return bpe.pair_counts(bpe.byte_tokens(_docs(spark, d), 3), 3)


def _train_sql(k: int) -> str:
    """k merges one by one: tokens are characters from U+0100 (bytes) and U+1000 (merges) on."""
    steps, prev = "", "s0"
    ident = lambda c: f"(case when unicode({c}) < 4096 then unicode({c}) - 253 else unicode({c}) - 4096 + 259 end)"
    for i in range(k):
        steps += f""",
p{i} as (select p[1] as l, p[2] as r, count(*) as f from (select unnest(list_zip(c[:-2], c[2:])) as p from (select string_split(s, '') as c from {prev})) where p[2] is not null group by 1, 2),
m{i} as materialized (select l, r, f from p{i} order by f desc, {ident("l")}, {ident("r")} limit 1),
s{i + 1} as materialized (select replace(s, l || r, chr({4096 + i})) as s from {prev}, m{i})"""
        prev = f"s{i + 1}"
    rows = " union all ".join(f"select {i} as rank, {ident('l')}::int as \"left\", {ident('r')}::int as \"right\", {259 + i} as new_token_id, f as frequency from m{i}" for i in range(k))
    return f"with s0 as materialized (select array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: chr(256 + ('0x' || x)::int)), '') as s from documents){steps} {rows}"


@query(_train_sql(1).replace("0 as rank, ", "").replace("259 as new_token_id, ", "").replace("as frequency", "as freq"))
def bpe_first_merge(spark, d):
    best = bpe.best_pair(bpe.pair_counts(bpe.byte_tokens(_docs(spark, d), 3), 3))
    return spark.createDataFrame([best], "left int, right int, freq long")


_K = 12


def _trained(spark, d, k: int = _K):
    return bpe.train(_docs(spark, d), TokenizerConfig(vocab_size=259 + k))


@query(_train_sql(_K))
def bpe_train(spark, d):
    return _trained(spark, d).merges.frame(spark)


def _stats_sql() -> str:
    cut = _train_sql(_K)
    at = cut.rindex(" select 0 as rank")
    final = f"(select sum(length(s) + 2)::bigint from s{_K})"
    return cut[:at] + f""", ms as ({cut[at + 1:]}), n as (select count(*) as num_documents, sum(octet_length(encode(text)) + 2)::bigint as initial_token_count from documents)
select num_documents, initial_token_count, {final} as final_token_count, 259::bigint as initial_vocab_size, {259 + _K}::bigint as final_vocab_size, {_K}::bigint as merge_count, initial_token_count / {final} as compression_ratio,
(select min(frequency) from ms)::bigint as least_frequency, (select max(frequency) from ms)::bigint as largest_frequency, (select avg(frequency) from ms) as mean_frequency from n"""


@query(_stats_sql())
def training_stats(spark, d):
    s = _trained(spark, d).statistics
    names = ("num_documents", "initial_token_count", "final_token_count", "initial_vocab_size", "final_vocab_size", "merge_count")
    of = s["merge_frequency_stats"]
    row = (*(s[n] for n in names), s["compression_ratio"], of["min"], of["max"], float(of["mean"]))
    return spark.createDataFrame([row], ", ".join(f"{n} long" for n in names) + ", compression_ratio double, least_frequency long, largest_frequency long, mean_frequency double")


@query()
def bpe_train_300(spark, d):
    """As many merges have no SQL that ends; training is tested against one-by-one training on small corpora."""
    return _trained(spark, d, 300).merges.frame(spark)


#: A fixed merge list: pairs of tokens, by their bytes.
FIXED_MERGES = ((b"t", b"h"), (b"e", b" "), (b"th", b"e "), (b"e", b"r"), (b"a", b"n"), (b"o", b"n"), (b"an", b"d"), (b"\xc3", b"\xa9"), (b"l", b"l"), (b"e", b"n"))


def fixed_tokenizer() -> Tokenizer:
    v, m = Vocabulary(), Merges()
    for left, right in FIXED_MERGES:
        m.record(v.ids[left], v.ids[right], v.add(left + right), 1)
    return Tokenizer(TokenizerConfig(vocab_size=len(v)), v, m)


def _encode_sql(text: str) -> str:
    v = fixed_tokenizer().vocabulary
    char = lambda b: f"chr({v.ids[b] - 3 + 256})"
    s = f"array_to_string(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: chr(256 + ('0x' || x)::int)), '')"
    for left, right in FIXED_MERGES:
        s = f"replace({s}, {char(left)} || {char(right)}, {char(left + right)})"
    return f"list_transform(list_filter(string_split({s}, ''), lambda c: c <> ''), lambda c: unicode(c) - 256 + 3)"


_ENCODED = f"select doc_id, array_to_string({_encode_sql('text')}, ' ') as ids from documents"


def _joined(c):
    return F.array_join(F.transform(c, lambda i: i.cast("string")), " ")


@query(_ENCODED)
def bpe_encode(spark, d):
    return _read(spark, d, "documents").select("doc_id", _joined(fixed_tokenizer().encode(F.col("text"))).alias("ids"))


@query(_ENCODED)
def bpe_encode_native(spark, d):
    return _read(spark, d, "documents").select("doc_id", _joined(fixed_tokenizer().encode_native(F.col("text"))).alias("ids"))


@query(f"select doc_id, '0 ' || ids || ' 1' as ids from ({_ENCODED})")
def bpe_encode_special(spark, d):
    return _read(spark, d, "documents").select("doc_id", _joined(fixed_tokenizer().encode_with_special_tokens(F.col("text"))).alias("ids"))


def _tokens_sql() -> str:
    v = fixed_tokenizer().vocabulary
    table = "[" + ", ".join(f"'{t.hex()}'" for t in v.tokens) + "]"
    return f"select item_id, array_to_string(list_transform({_encode_sql('text')}, lambda i: i || ':' || ({table})[i + 1]), ' ') as tokens from benchmark"


@query(_tokens_sql())
def bpe_tokenize(spark, d):
    found = fixed_tokenizer().tokenize(F.col("text"))
    return _read(spark, d, "benchmark").select("item_id", F.array_join(F.transform(found, lambda t: F.concat(t["id"].cast("string"), F.lit(":"), t["bytes"])), " ").alias("tokens"))


@query("select doc_id, text from documents")
def bpe_decode_roundtrip(spark, d):
    t = fixed_tokenizer()
    return _read(spark, d, "documents").select("doc_id", t.decode(t.encode(F.col("text"))).alias("text"))


_BYTES = "array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::int + 3), ' ')"


@query(f"select doc_id, {_BYTES} as ids from documents")
def byte_encode(spark, d):
    return _read(spark, d, "documents").select("doc_id", _joined(Tokenizer().byte_encode(F.col("text"))).alias("ids"))


@query(f"select doc_id, '0 ' || {_BYTES} || ' 1' as ids from documents")
def byte_encode_document(spark, d):
    return _read(spark, d, "documents").select("doc_id", _joined(Tokenizer().byte_encode_document(F.col("text"))).alias("ids"))


@query("select doc_id, text from documents")
def byte_decode(spark, d):
    t = Tokenizer()
    return _read(spark, d, "documents").select("doc_id", t.byte_decode(t.byte_encode_document(F.col("text"))).alias("text"))


@query("select item_id, '<DOCUMENT_START>' || regexp_replace(text, '[^\\x00-\\x7f]', '?', 'g') || '<DOCUMENT_END>' as text from benchmark")
def bpe_decode_special(spark, d):
    """Each token is decoded alone, so characters that no token holds whole are replaced first."""
    t = fixed_tokenizer()
    plain = F.regexp_replace("text", r"[^\x00-\x7f]", "?")
    return _read(spark, d, "benchmark").select("item_id", t.decode_with_special_tokens(t.encode_with_special_tokens(plain)).alias("text"))


@query("select i as id, case when i < 3 then ['3c444f43554d454e545f53544152543e', '3c444f43554d454e545f454e443e', '3c554e4b3e'][i + 1] else right('0' || lower(to_hex(i - 3)), 2) end as bytes, case when i < 3 then 'special' else 'byte' end as type from (select unnest(range(0, 259))::int as i)")
def vocab_table(spark, d):
    return Vocabulary().frame(spark).withColumn("bytes", F.lower(F.hex("bytes")))


def _inspect_sql() -> str:
    rows = " union all ".join(f"select {i} as rank, '{a.hex()}' as left_bytes, '{b.hex()}' as right_bytes, '{(a + b).hex()}' as new_bytes, 1::bigint as frequency" for i, (a, b) in enumerate(FIXED_MERGES))
    return rows


@query(_inspect_sql())
def merge_inspect(spark, d):
    return fixed_tokenizer().inspect_merges(spark)


@query("select 255 as id union all select 257")
def vocabulary_gaps(spark, d):
    return checks.vocabulary_gaps(Vocabulary().frame(spark).where("id not in (256, 258)").unionByName(spark.createDataFrame([(259, bytearray(b"x"), "bpe")], "id int, bytes binary, type string")))


@query("select 9 as rank, 'left' as side, 9999 as id union all select 9, 'new', 12345")
def dangling_merges(spark, d):
    t = fixed_tokenizer()
    m = t.merges.frame(spark).unionByName(spark.createDataFrame([(9, 9999, 3, 12345, 1)], "rank int, left int, right int, new_token_id int, frequency long"))
    return checks.dangling_merges(m, t.vocabulary.frame(spark))
