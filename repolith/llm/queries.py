"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm import curves, decontam, jaccard, langid, lm, pieces, pii, quality, repeats, secret_scan, tokenids, variants, whitening
from repolith.llm.common import stopped_batches, table


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is on this machine and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    stopped_batches(spark)
    return table(spark, sf_dir, "documents")


def remainder(key: str, n: int):
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % n


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, as ``pii.find`` says."""
    return pii.digest(pii.find(_documents(spark, sf_dir)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, verdict and posterior of all documents, as ``quality.score`` says."""
    return quality.score(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of those that are not held out, as ``lm.score`` says."""
    held = remainder("doc_id", 7) == 2
    out = lm.score(_documents(spark, sf_dir), ~held)
    return out.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document is not a repeat of an earlier one, as ``repeats.remove`` says."""
    return repeats.remove(_documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each document's set and the least document it is linked with, as ``jaccard.near_duplicates`` says."""
    return jaccard.near_duplicates(_documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they leak, as ``decontam.leaks`` says."""
    return decontam.leaks(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to files and read back, as ``tokenids.write_and_read`` says."""
    return tokenids.write_and_read(_documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those not held out, as ``langid.predict`` says."""
    docs = _documents(spark, sf_dir)
    held = remainder("doc_id", 5) == 0
    model = langid.fit(docs.where(~held))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of all documents and whether they decode to the text, as ``pieces.encode`` says."""
    path = tokenizer_file("piece_bpe_32k.model")
    done = pieces.decode(pieces.encode(_documents(spark, sf_dir).select("doc_id", "text"), path), path)
    digest = F.crc32(F.encode(F.array_join("pieces", ","), "UTF-8"))
    return done.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), digest.alias("ids_crc32"), F.octet_length("decoded").cast("long").alias("n_bytes"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in all documents and what the forest says of them, as ``secret_scan.scan`` says."""
    return secret_scan.scan(_documents(spark, sf_dir), secret_scan.fit(secret_scan.labelled_findings(spark)))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their forms and roots, as ``variants.group`` says."""
    return variants.group(_documents(spark, sf_dir))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every hundredth embedding, as ``curves.search`` says."""
    return curves.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 32 whitened components of every embedding, as ``whitening.whiten`` says."""
    return whitening.components(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_quality": op2_quality,
        "op3_lm_score": op3_lm_score,
        "op4_repeats": op4_repeats,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_decontamination": op6_decontamination,
        "op7_token_ids": op7_token_ids,
        "op8_language_id": op8_language_id,
        "op9_pieces": op9_pieces,
        "op10_secrets": op10_secrets,
        "op11_variants": op11_variants,
        "op12_neighbours": op12_neighbours,
        "op13_whitening": op13_whitening,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CLEAN = """regexp_extract_all(translate(lower(coalesce(text, '')), '.,;:!?"''()[]{}', ''), '[^\\x20\\x09-\\x0D]+')"""

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
 t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS x, any_value(b.n) AS y FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (x + y - k) UNION ALL SELECT b, a FROM p WHERE 100 * k >= 80 * (x + y - k)),
 r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
 SELECT doc_id, len(s) AS n_shingles, least AS component_id FROM s JOIN m ON m.a = s.doc_id"""

LEAKS = f"""WITH items AS (SELECT item_id, {_CLEAN} AS w FROM benchmark), docs AS (SELECT doc_id, {_CLEAN} AS w FROM documents),
 i AS (SELECT item_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS j FROM items WHERE len(w) >= 4), d AS (SELECT doc_id, len(w) AS dn, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS k FROM docs),
 m AS (SELECT doc_id, item_id, k - j AS shift, j, n, dn FROM d JOIN i USING (w)), g AS (SELECT doc_id, item_id, shift FROM m GROUP BY ALL HAVING 100 * count(*) >= 80 * least(20, any_value(n))),
 x AS (SELECT m.*, count(*) OVER (PARTITION BY doc_id, item_id, shift) AS n_matched, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j RANGE BETWEEN CURRENT ROW AND (least(20, n) - 1) FOLLOWING) AS window_ FROM m JOIN g USING (doc_id, item_id, shift)),
 y AS (SELECT doc_id, item_id, shift AS first_word, n AS n_item_words, n_matched, max(window_) AS best_window FROM x WHERE least(n, dn - shift) - greatest(0, -shift) >= least(20, n) GROUP BY ALL HAVING 100 * max(window_) >= CASE WHEN n < 8 THEN 100 ELSE 80 END * least(20, n)
 UNION ALL SELECT doc_id, item_id, 0, len(w), len(w), len(w) FROM docs JOIN items USING (w) WHERE len(w) BETWEEN 1 AND 3)
 SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best_window DESC, n_matched DESC, first_word) = 1"""


def oracle_sql() -> dict[str, str]:
    """SQL of the two operators that it can express in full, by plain joins of all words."""
    return {"op5_jaccard_join": NEAR_DUPLICATES, "op6_decontamination": LEAKS}
