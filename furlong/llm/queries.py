"""The registered queries of these operators: query(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from furlong.llm import conversations, decontaminate, html_text, lines, minhash, packing, positive_unlabelled, quality, records, suffixes, tokens, toxicity, variants, warc
from furlong.llm.oracles import OP11_SQL, OP13_SQL
from furlong.llm.store import load, new_path


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, and the sentences at fault.

    Null and empty texts are scored as one sentence without words; repeated ids
    are scored each; null ids are not held out; no labels give a model without
    features, an empty table no rows; other columns are not read.
    """
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "sentences")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's ids, from the record files.

    Null and empty texts have the end id alone; rows of one id stand side by
    side, null ids come first; an empty table gives no rows; other columns are
    not read.
    """
    shards = records.write_records(load(spark, sf_dir, "documents"), new_path(spark, "token-records"), tokens.vocabulary(), end_id=2)
    return records.read_records(shards, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each document's set, its group and whether it stays.

    Texts without words are linked with nothing; rows without an id are left out,
    rows of one id are judged each by its text; ties are won by the smallest id;
    an empty table gives no rows; other columns are not read.
    """
    return minhash.near_duplicates(load(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each page's record, looked up in the archives by its URL.

    Null html is an empty payload, a null or empty URL has a key of its own; of
    equal payloads the largest id is the response; rows of one id are all
    written; an empty table gives no rows; other columns are not read.
    """
    return warc.archived(load(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and dropped lines of each document that keeps any, and its text.

    Null and empty texts and null ids stay as they are; rows of one id with
    different texts are different documents, equal rows are one; ties are won by
    the smallest id, text and line; an empty table gives no rows.
    """
    return lines.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page.

    Null and empty html has an empty text; each row is treated by itself, null
    and repeated ids too; an empty table gives no rows; other columns are not
    read.
    """
    return html_text.extract(load(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule values, compression ratios and verdict of every document.

    Null and empty texts fail; each row is judged by itself, null and repeated
    ids too; an empty table gives no rows; other columns are not read.
    """
    return quality.quality(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items found in them.

    Null texts, null items and items without words match nothing; rows of one id
    are counted together, null ids as one; equal scores all count; empty tables
    give no rows; other columns are not read.
    """
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document's ids, their sequences, buckets and batches.

    Null and empty texts have the end id alone; each row is packed by itself, null
    and repeated ids too; an empty table gives no rows; other columns are not
    read.
    """
    return packing.pack(load(spark, sf_dir, "documents"), tokens.vocabulary(), ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "batch")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and runs removed from every document, and a digest of the rest.

    Null and short texts and rows without an id lose nothing; rows of one id are
    one document, whose equal places are no repeats; an empty table gives no
    rows; other columns are not read.
    """
    return suffixes.remove_repeats(load(spark, sf_dir, "documents"), keep=False)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every conversation after damage, the cheapest edits and a digest of what they give.

    Null roles and texts are one space, null turns come first, a null conv_id is a
    conversation; rows of one turn are taken by role and text, copies side by
    side; texts and conversations of any length are read whole; an empty table
    gives no rows; other columns are not read.
    """
    return conversations.repair(load(spark, sf_dir, "conversations"), damaged=True)


def op12_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and prediction of every document, learnt from positives and unlabelled text.

    Null and empty texts are scored as texts without words; repeated ids are
    scored each; null ids are not held out; texts of any length are read whole;
    without positives every score is 0.5; an empty table gives no rows; other
    columns are not read.
    """
    return positive_unlabelled.quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some of them spoilt, with the more common words they may be variants of.

    Null texts have no words, a null id counts as empty text; repeated rows count
    each; of near words of equal n the first in code-point order is the form;
    texts are read whole; an empty table gives no rows; other columns are not read.
    """
    return variants.variants(load(spark, sf_dir, "documents"))


OP3_SQL = """with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
    s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [len(w)::varchar || chr(10) || array_to_string(w, ' ')] else [] end) x from d),
    n as (select doc_id, count(*) n from s group by 1),
    p as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
    l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
    e as (select a, b from l union all select b, a from l),
    r as (select a id, a r from e union select r.id, e.b from r join e on e.a = r.r),
    c as (select id, min(r) c from r group by 1)
    select d.doc_id, coalesce(n, 0) n_shingles, coalesce(c, d.doc_id) component_id, coalesce(c, d.doc_id) = d.doc_id kept from d left join n on n.doc_id = d.doc_id left join c on c.id = d.doc_id"""
OP4_SQL = """with p as (select page_id, encode(coalesce(html, '')) h from pages), d as (select page_id, octet_length(h) n, sha1(h) hex from p),
    m as (select hex, max(page_id) last from d group by 1)
    select page_id, n payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(hex, (i // 4 * 5 + 1)::bigint, 5))::bigint >> (15 - 5 * (i % 4))) & 31))::bigint, 1)), '') payload_digest,
    case when page_id = last then 'response' else 'revisit' end record_type, case when page_id <> last then last end refers_to from d join m using (hex)"""
OP10_SQL = """with d as (select doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n from documents),
    s as (select doc_id, unnest(range(0, n - 99)) p, unnest(list_transform(range(0, n - 99), lambda p: md5_number(substr(h, 2 * p + 1, 200)))) x from d where n >= 100),
    k as (select doc_id, p from (select doc_id, p, row_number() over (partition by x order by doc_id, p) i from s) where i > 1),
    g as (select *, case when p > lag(p) over w + 100 or lag(p) over w is null then 1 else 0 end new from k window w as (partition by doc_id order by p)),
    r as (select doc_id, run, min(p) first, max(p) + 100 last from (select doc_id, p, sum(new) over (partition by doc_id order by p) run from g) group by 1, 2),
    e as (select doc_id, first, last, lag(last, 1, 0) over (partition by doc_id order by run) before from r),
    t as (select doc_id, sum(last - first) n_removed, count(*) n_spans, max(last) last from e group by 1),
    x as (select e.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (first - before)), '' order by first) kept from e join d on d.doc_id = e.doc_id group by 1)
    select d.doc_id, n n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) kept_sha256 from d left join t on t.doc_id = d.doc_id left join x on x.doc_id = d.doc_id"""

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_records, op3_minhash, op4_warc, op5_line_dedup, op6_html_text, op7_quality, op8_decontaminate, op9_packing, op10_suffix_dedup, op11_conversation_repair, op12_pu_quality, op13_spelling_variants)}
ORACLES: dict[str, str] = {"op3_minhash": OP3_SQL, "op4_warc": OP4_SQL, "op10_suffix_dedup": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op13_spelling_variants": OP13_SQL}
"""The others have no SQL: models, token ids, compression ratios and trees have no form there; tests compare them with brute force."""
