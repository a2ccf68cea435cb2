"""Registered queries of this subpackage: thin digests of its operators over the whole tables."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.llm.samples import small_batches
from seqloom.registry import Entry

ENTRIES: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None):
    def add(build):
        ENTRIES[name] = Entry(build, textwrap.dedent(oracle).strip() if oracle else None)
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_suffix_dedup")
def suffix_dedup(spark, sf_dir):
    from seqloom.llm.suffixes import remove_repeated_bytes

    return remove_repeated_bytes(table(spark, sf_dir, "documents"))


@query("op9_substring_dedup")
def substring_dedup(spark, sf_dir):
    from seqloom.llm.windows import remove_repeated_windows

    return remove_repeated_windows(table(spark, sf_dir, "documents"))


@query("op1_decontamination")
def decontamination(spark, sf_dir):
    from seqloom.llm.benchmark import find_items

    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


@query("op2_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    import public_tokenizers

    from seqloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_language_id")
def language_id(spark, sf_dir):
    from seqloom.llm.language import fit, identify

    documents = table(spark, sf_dir, "documents")
    return identify(documents, fit(documents))


@query("op10_toxicity")
def toxicity(spark, sf_dir):
    from seqloom.llm.toxicity import fit, score

    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return score(documents, model, model.grams)


@query("op5_quality_rules")
def quality_rules(spark, sf_dir):
    from seqloom.llm.quality import apply_rules, fit

    documents = table(spark, sf_dir, "documents")
    found = apply_rules(documents, fit(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_ngram_jaccard")
def ngram_jaccard(spark, sf_dir):
    from seqloom.llm.jaccard import link_documents

    return link_documents(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    from seqloom.llm import licenses as L

    templates = ", ".join(f"('{label}', string_split('{s}', ' '))" for label, of in L.TEMPLATES.items() for s in of)
    phrases = ", ".join(f"('{label}', string_split('{p}', ' '))" for p, label in L.PHRASES.items())
    return rf"""
        WITH t(label, tokens) AS (SELECT label, list_distinct(tokens) FROM (VALUES {templates}) v(label, tokens)),
        p(label, parts) AS (VALUES {phrases}),
        d AS (SELECT row_number() OVER () AS r, doc_id,
                     regexp_extract_all(translate(coalesce(text, ''), '{L._UPPER}', '{L._LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS words
              FROM documents),
        w AS (SELECT r, unnest(range(len(words))) AS pos, words FROM d),
        base AS (SELECT r, pos, label FROM w JOIN p ON words[pos + 1] = parts[1] AND words[pos + 1 : pos + len(parts)] = parts),
        b AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY r),
        blocks AS (SELECT r, words[16 * pos + 1 : 16 * pos + 32] AS block
                   FROM (SELECT r, words, unnest(range(greatest(cast(ceil(len(words) / 16.0) AS BIGINT) - 1, 1))) AS pos FROM d)),
        m AS (SELECT r, label, len(list_intersect(tokens, list_distinct(block))) / len(tokens) AS share FROM blocks, t),
        f AS (SELECT r, list(DISTINCT label) AS found, max(share) AS share FROM m WHERE share >= {L.CONTAINED} - 1e-9 GROUP BY r)
        SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(array_to_string(labels, ','), '') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(found, [])))), ',') AS labels,
               greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
        FROM d LEFT JOIN b USING (r) LEFT JOIN f USING (r)
    """


@query("op3_license_scan", _license_sql())
def license_scan(spark, sf_dir):
    from seqloom.llm.licenses import find_licenses

    return find_licenses(table(spark, sf_dir, "documents"))


@query("op7_line_dedup", r"""
    WITH l AS (SELECT doc_id, source, md5(coalesce(text, '')) AS key, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
                      unnest(string_split(text, chr(10))) AS line FROM documents),
    w AS (SELECT line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT source) >= 8),
    k AS (SELECT l.*, line IN (SELECT line FROM w) AND (rank() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, key, pos)) > 1 AS gone FROM l)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM k GROUP BY doc_id
""")
def line_dedup(spark, sf_dir):
    from seqloom.llm.boilerplate import spread_lines

    found = spread_lines(table(spark, sf_dir, "documents"))
    removed = F.size("line_numbers_removed").cast("long").alias("n_removed")
    return found.select("doc_id", "n_lines", removed, F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"


@query("op13_ranked_search", f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
    s AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
    c AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
    w AS (SELECT term, floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM c, s GROUP BY term),
    m AS (SELECT r, doc_id, 100 - 25 + ((25 * len(terms) * docs) // total) AS m FROM d, s WHERE len(terms) > 0),
    i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark),
    q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(terms) AS term FROM i) GROUP BY i, item_id, term),
    h AS (SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
          FROM q JOIN w USING (term) JOIN c USING (term) JOIN m USING (r) GROUP BY i, item_id, r, doc_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM h WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 20
""")
def ranked_search(spark, sf_dir):
    from seqloom.llm.search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_fingerprints")
def fingerprints(spark, sf_dir):
    from seqloom.llm.fingerprints import compare_with_edits

    return compare_with_edits(table(spark, sf_dir, "documents"))


@query("op11_whitening")
def whitening(spark, sf_dir):
    from seqloom.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))
