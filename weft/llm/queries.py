"""The operators as queries over whole tables, one ``opN_<name>`` each, and their SQL where SQL has one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import alignment, decontam, filter_audit, fixity, language, licenses, neardup, packing, quality, repeats, rules, token_files, toxicity
from weft.llm import lines as ln
from weft.session import scratch_path

END_ID = 2


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (least doc_id of the component of links), n_links (other documents 0.8 alike or more, copies included)."""
    return neardup.join(texts(spark, sf_dir))


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    field = rules.train(docs, table(spark, sf_dir, "labels"))
    return rules.verdicts(docs, field).select("doc_id", "verdict.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scores(docs, model)
    return scored.select("doc_id", (ln.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "toxicity.*")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.train(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    found = language.identify(texts(spark, sf_dir), model)
    return found.select("doc_id", (ln.fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.rejected")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.layout(texts(spark, sf_dir), tokenizer("word_bpe_49k.json"), END_ID, added=True)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, f"token_files/{uuid.uuid4().hex}")
    token_files.write(texts(spark, sf_dir), folder, tokenizer("byte_bpe_50k.json"), END_ID, added=True)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(texts(spark, sf_dir))
    return found.select("doc_id", *(f"license.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    hits = F.col("hits")
    n = decontam.n_hit(hits)
    joined = F.array_join(F.array_sort(F.transform(hits["items"], lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", hits["n_words"].alias("n_words"), n.alias("n_hit"), F.size(hits["items"]).cast("bigint").alias("n_items"),
        F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (n > 0).alias("contaminated"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scores(docs, field).select("doc_id", (ln.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "quality.*")


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the pages' WARC records in which some ids' records are damaged, and returns every damaged one.

    The damage is planted by page_id: missing where it is 13 modulo 151, else
    cut to 40 bytes where it is 11 modulo 97, else with another byte in
    its version where it is 7 modulo 61.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    own = pages.select("page_id", fixity.record(F.col("page_id"), F.col("url"), F.col("html")).alias("bytes"))
    key, raw = F.col("page_id"), F.col("bytes")
    copy = (
        F.when(key % 151 == 13, F.lit(None).cast("binary")).when(key % 97 == 11, F.substring(raw, 1, 40))
        .when(key % 61 == 7, F.concat(F.lit("WARC/0").cast("binary"), F.expr("substring(bytes, 7)"))).otherwise(raw)
    )
    listed = fixity.manifest(own, "page_id", copy_length=F.octet_length(copy).cast("bigint"), copy_digest=F.sha2(copy, 256))
    held = listed.where("copy_digest is not null").select("place", "offset", F.col("copy_length").alias("length"), F.col("copy_digest").alias("digest"))
    return fixity.audit(listed, held).withColumnRenamed("key", "page_id")


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(texts(spark, sf_dir))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.alignments(texts(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, every order of them, by source; a document is good or toxic if any of its labels says so."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    failed = filter_audit.failures(docs).drop("text")
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return filter_audit.audit(failed.join(marks, "doc_id", "left"), F.col("source"), F.col("good"), F.col("toxic"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_line_rules, op3_toxicity, op4_language, op5_packing, op6_token_files, op7_license_scan, op8_decontamination, op9_quality, op10_warc_fixity, op11_repeats, op12_alignment, op13_filter_audit, pipeline)}

# words as the operators take them
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op1_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])
                                         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE ['blank:' || coalesce(text, '')] END) AS sh FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 9 * c >= 4 * (p.n + q.n)),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
        SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links
        FROM (SELECT x AS doc_id, min(y) AS class_id FROM r GROUP BY x) LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY x) USING (doc_id)""",
    "op8_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        v AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS x
              FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
        k AS (SELECT DISTINCT k FROM v),
        g AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, k WHERE len(w) >= k)),
        h AS (SELECT doc_id, item_id, g.k, p FROM g JOIN v ON g.k = v.k AND g.x = v.x),
        t AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
        u AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN t USING (doc_id) LEFT JOIN u USING (doc_id)""".replace(' COLLATE "C"', ""),
    "op10_warc_fixity": """
        WITH b AS (SELECT *, chr(13) || chr(10) AS nl, coalesce(html, '') AS body FROM pages),
        r AS (SELECT page_id, 'WARC/1.1' || nl || 'WARC-Type: response' || nl || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || nl || 'WARC-Target-URI: ' || coalesce(url, '')
                     || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen(body) || nl || nl || body || nl || nl AS x FROM b),
        c AS (SELECT page_id, strlen(x) AS length, sha256(x) AS expected,
                     sha256(CASE WHEN page_id % 151 = 13 THEN NULL WHEN page_id % 97 = 11 THEN x[:40] WHEN page_id % 61 = 7 THEN 'WARC/0' || x[7:] ELSE x END) AS found,
                     CASE WHEN page_id % 151 = 13 THEN 'missing' WHEN page_id % 97 = 11 THEN 'length' ELSE 'bytes' END AS damage FROM r),
        p AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, expected) - 1 AS place FROM c),
        o AS (SELECT *, place // 1024 AS file FROM p)
        SELECT * FROM (SELECT page_id, place, file, CAST(sum(length) OVER (PARTITION BY file ORDER BY place) - length AS BIGINT) AS "offset", length, expected, found, damage FROM o)
        WHERE found IS DISTINCT FROM expected""",
    "op13_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        m AS (SELECT x, min(doc_id) AS least FROM t GROUP BY x),
        q AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        d AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x),
                            regexp_matches(x, '[#$%&*|]'), coalesce(t.doc_id > m.least, false)] AS f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
              FROM t JOIN m USING (x) LEFT JOIN q USING (doc_id)),
        c AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
        l AS (SELECT unnest(range(1, 6)) AS k),
        o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
        r AS (SELECT part, o, f, n, good, toxic, list_min(list_filter(range(1, 6), lambda s: f[o[s]])) AS gone FROM c, o),
        s AS (SELECT part, o, k AS step, o[k] AS filter,
                     sum(n) FILTER (gone IS NULL OR gone > k) AS kept, sum(n) FILTER (gone = k) AS removed, sum(n) FILTER (f[o[k]] AND gone < k) AS redundant,
                     sum(n) FILTER (f[o[k]] AND len(list_filter(f, lambda z: z)) = 1) AS unique_fails, sum(good) FILTER (gone = k) AS good_lost, sum(toxic) FILTER (gone = k) AS toxic_lost
              FROM r, l GROUP BY part, o, k)
        SELECT part, array_to_string(list_transform(o, lambda z: 'ABCDE'[z]), '') AS filter_order, CAST(step AS INTEGER) AS step,
               CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
               CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
               CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter), 0) AS BIGINT) AS shapley
        FROM s""",
}
