"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table
from .bpe import encode_and_decode, listed
from .decontaminate import find_leaks
from .exact_dedup import mark_copies
from .line_dedup import MIN_PAGES, RATIO, drop_boilerplate
from .near_dedup import similarity_classes
from .phrases import collocations
from .pii import find_pii
from .ranked_search import search
from .token_counts import count_tokens
from .token_files import token_index, write_tokens
from .toxicity import score_toxicity
from .url_rules import judge_urls, rule_frame
from .vector_dedup import vector_classes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Fixed values of the url query's contract: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def bpe_digests(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) encoded and decoded, as digests."""
    out = encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed(F.col("ids")).cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as read back from their range-coded token files."""
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_index(spark, path).withColumnRenamed("id", "doc_id")


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document: its digest, and the lines before and dropped."""
    out = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


ORACLE["op3_line_dedup"] = f"""
WITH lines AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS page, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
totals AS (SELECT coalesce(source, '') AS host, count(DISTINCT coalesce(text, '')) AS pages FROM documents GROUP BY 1),
bad AS (SELECT host, trim(line, ' ') AS line FROM lines JOIN totals USING (host) WHERE trim(line, ' ') <> '' GROUP BY host, trim(line, ' '), pages
        HAVING count(DISTINCT page) >= {MIN_PAGES} AND count(DISTINCT page) > {RATIO}::DOUBLE * pages),
marked AS (SELECT l.doc_id, l.k, l.line, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.host = b.host AND trim(l.line, ' ') = b.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS text_sha256 FROM marked GROUP BY doc_id
"""


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, or a re-parameterised one, with the item."""
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), verbatim=True)


@query
def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document; class_id is the smallest doc_id in it."""
    return similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size")


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


ORACLE["op9_exact_dedup"] = """
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(coalesce(d.text, '')) AS text_sha256
FROM documents d JOIN (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g ON coalesce(d.text, '') = g.t
"""


@query
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rule_frame(spark, URL_RULES))


ORACLE["op10_url_rules"] = r"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (SELECT p.page_id, p.host, p.path, rh || rp AS rule, v, row_number() OVER (PARTITION BY p.page_id ORDER BY length(rh || rp) DESC) AS k
         FROM parts p JOIN rules ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.k = 1
"""


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest collocations of each language."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE["op11_phrases"] = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, w, len(w) AS m FROM (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces) WHERE len(w) > 0),
totals AS (SELECT lang, CAST(sum(m) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, k, w, unnest(range(1, m - k + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE m >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
longer AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (SELECT lang, phrase, f AS a, cut, array_to_string(w[1:cut], ' ') AS one, array_to_string(w[cut + 1:k], ' ') AS two FROM (SELECT *, unnest(range(1, k)) AS cut FROM longer)),
scored AS (SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS BIGINT) AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.one JOIN f y ON y.lang = c.lang AND y.phrase = c.two),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(f) AS cover FROM (SELECT *, unnest(range(1, k - n + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS n FROM longer WHERE k >= 3)) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE cover IS NULL OR 100::HUGEINT * cover < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def _term_sql(source: str, key: str) -> str:
    """(key, term, tf) of a table's texts."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM {source}) GROUP BY {key}, term"


ORACLE["op12_ranked_search"] = f"""
WITH d AS ({_term_sql("documents", "doc_id")}), q AS ({_term_sql("benchmark", "item_id")}),
lens AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM d GROUP BY doc_id),
totals AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lens),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM d, totals GROUP BY term),
scores AS (SELECT q.item_id, d.doc_id, CAST(sum(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
           FROM q JOIN d USING (term) JOIN weights USING (term) JOIN lens USING (doc_id), totals GROUP BY q.item_id, d.doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query
def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of each label: partners, and the smallest vec_id that links reach."""
    return vector_classes(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


ORACLE["op13_vector_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reached(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON r.b = p.a),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
degrees AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM roots LEFT JOIN degrees USING (vec_id)
"""
